"""Helpers shared by the training-data operators: shared storage, Arrow slicing
and a small contract for table inputs."""

from __future__ import annotations

import ctypes
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package

#: Text handed to one numpy/Python step at a time, in bytes.
SLICE_BYTES = 2 << 20


#: Rows and bytes of an Arrow batch at most: batches of whole texts are held by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch sizes to BATCH_ROWS and BATCH_BYTES where they are larger."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        found = spark.conf.get(name)
        if not (found.isdigit() and 0 < int(found) <= most):
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    It is set here only where the session names none, and then only for a
    local master: a cluster without a shared folder is an error.
    """
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None and context.getCheckpointDir() is not None:
        found = context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        found = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(found)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def pinned(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with its lineage cut.

    Later stages read these files, so losing an executor never repeats the
    work, and values made from task ids cannot change between reads.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, n_bytes: int | None = None, each: int = 16 << 20) -> int:
    """Shuffle width: the session's own, or more where the bytes ask for it."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(base, -(-(n_bytes or 0) // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of the whole column (one number for sizing shuffles)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0)).alias("n")).first()["n"]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Sub-batches of about ``most`` bytes of text; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(lengths).astype(np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and n + 1 offsets; nulls are empty."""
    array = batch.column(batch.schema.get_field_index(column))
    values = [b"" if v is None else v for v in array.cast(pa.large_binary()).to_pylist()]
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), np.uint8), offsets


def one_thread() -> None:
    """Native libraries in a Python worker use the task's core only."""
    for name in ("RAYON_NUM_THREADS", "OMP_NUM_THREADS"):
        os.environ[name] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


_trimmed = 0.0


def _trim() -> None:
    """Hands freed memory back to the system, which a worker that waits for its
    next task would else keep; at most every half second."""
    global _trimmed
    if time.monotonic() - _trimmed > 0.5:
        _trimmed = time.monotonic()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library


def lean(run):
    """A mapInArrow function that leaves its worker small."""

    def batches(given):
        for out in run(given):
            yield out
            _trim()
        _trim()

    return batches


def lean_group(run):
    """The same for a function of one group."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        _trim()
        return out

    return group


def lean_cogroup(run):
    """The same for a function of two groups."""

    def groups(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        _trim()
        return out

    return groups
