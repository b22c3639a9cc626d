"""Token-id files in Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 payload bits: the selector says
how many ids of how many bits follow. Ids are coded in blocks of a fixed
count; the file keeps every block's first word, so any block can be decoded
alone, and all words of one selector are decoded in one vector step. An id
of over 60 bits is an escape: its place in the words is a zero and its value
stands in the block's escape list.

File layout, little-endian: header (magic, version, documents, ids, words,
escapes, block size), document ids (i64), document lengths (u32), first word
of each block (u32), words (u64), escapes (place u64, value u64), CRC-32 of
all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, lean, pinned, sliced, stash_path

MAGIC, VERSION = b"TMS8B\x00\x00\x00", 1
HEADER = struct.Struct("<8sIQQQQI")
BLOCK = 4096
#: Ids at which a file is closed (at a document's end), and documents per range of ids.
FILE_IDS, RANGE_DOCS = 1 << 20, 2048
MOST_RANGES = 20_000
END = 1
#: Selector s holds COUNTS[s] ids of 60 // COUNTS[s] bits.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
WIDTHS = 60 // COUNTS
#: Exclusive limits of the widths, rising; and for small values the densest selector each fits.
_LIMITS = (np.uint64(1) << WIDTHS[::-1].astype(np.uint64)).astype(np.uint64)
_FITS = (len(COUNTS) - np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64), side="right")).astype(np.int8) - np.int8(1)


def encode_words(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes as rows of place and value) of uint64 values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    wide = np.flatnonzero(values >> np.uint64(60))
    escapes = np.stack([wide.astype(np.uint64), values[wide]], 1) if len(wide) else np.zeros((0, 2), np.uint64)
    plain = values.copy()
    plain[wide] = 0
    # Of each value the densest selector it fits; of a place, the densest whose next ids all fit.
    fits = _FITS[plain] if not n or plain.max() < len(_FITS) else (len(COUNTS) - np.searchsorted(_LIMITS, plain, side="right")).astype(np.int8) - 1
    padded = np.concatenate([plain, np.zeros(60, np.uint64)])
    least = np.concatenate([fits, np.full(60, len(COUNTS) - 1, np.int8)])
    choice = np.zeros(n, np.int8)
    power, top = 1, int(fits.max(initial=0))
    for s, c in enumerate(COUNTS[: top + 1].tolist()):
        while 2 * power <= c:
            least = np.minimum(least, np.concatenate([least[power:], np.full(power, len(COUNTS) - 1, np.int8)]))
            power *= 2
        good = np.minimum(least[:n], least[c - power : c - power + n]) >= s
        choice[good] = s
    # All blocks are walked at once, a word of each in a step.
    steps, now = COUNTS[choice], np.arange(0, n, block)
    limits, which = np.minimum(now + block, n), np.arange(len(now))
    starts, owners = [], []
    while len(now):
        starts.append(now)
        owners.append(which)
        now = now + steps[now]
        left = now < limits
        if not left.all():
            now, limits, which = now[left], limits[left], which[left]
    at = np.sort(np.concatenate(starts)) if n else np.zeros(0, np.int64)
    firsts = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owners)))[:-1]]) if n else []
    words = choice[at].astype(np.uint64) << np.uint64(60) if n else np.zeros(0, np.uint64)
    ends = np.minimum(n, (at // block + 1) * block)
    for s, (c, w) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        mine = np.flatnonzero(choice[at] == s) if n else []
        if len(mine):
            places = at[mine][:, None] + np.arange(c)
            got = padded[np.minimum(places, n + 59)] * (places < ends[mine][:, None])
            words[mine] |= np.bitwise_or.reduce(got << (np.arange(c, dtype=np.uint64) * np.uint64(w)), axis=1)
    return words, np.array(firsts, np.uint32), escapes


def decode_words(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors] if len(words) else np.zeros(0, np.int64)
    # Where each word's first id goes: counted from its block's first word.
    total = np.concatenate([[0], np.cumsum(counts)])
    which = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts.astype(np.int64), len(words))))
    starts = total[:-1] - total[firsts.astype(np.int64)][which] + which * block
    ends = np.minimum(n, (which + 1) * block)
    out = np.zeros(n + 60, np.uint64)
    for s, (c, w) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        mine = np.flatnonzero(selectors == s)
        if len(mine):
            got = (words[mine][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))) & np.uint64((1 << w) - 1)
            places = starts[mine][:, None] + np.arange(c)
            inside = places < ends[mine][:, None]
            out[places[inside]] = got[inside]
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out[:n]


def write_file(doc_ids: list[int], documents: list[np.ndarray], block: int = BLOCK) -> bytes:
    """One file's bytes; a document id of None is written as the smallest i64."""
    ids = np.concatenate(documents).astype(np.uint64) if documents else np.zeros(0, np.uint64)
    words, firsts, escapes = encode_words(ids, block)
    keys = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    body = HEADER.pack(MAGIC, VERSION, len(keys), len(ids), len(words), len(escapes), block)
    body += keys.tobytes() + np.array([len(d) for d in documents], "<u4").tobytes() + firsts.astype("<u4").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """(document ids, each document's uint32 or uint64 ids); a damaged file is
    an error, bytes after its end are none of it."""
    magic, version, docs, n, n_words, n_escapes, block = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id file of this version")
    end = HEADER.size + 12 * docs + 4 * -(-n // block) + 8 * n_words + 16 * n_escapes
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("checksum mismatch")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    keys, lengths = take("<i8", docs), take("<u4", docs)
    firsts, words = take("<u4", -(-n // block)), take("<u8", n_words)
    escapes = take("<u8", 2 * n_escapes).reshape(-1, 2)
    ids = decode_words(words, firsts, escapes, n, block)
    return [None if k == -(1 << 63) else k for k in keys.tolist()], np.split(ids, np.cumsum(lengths.astype(np.int64))[:-1]) if docs else []


def write(docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes docs' ids (the end id after each document) as files in ascending
    order of the key.

    Each file lies in a folder of its own, whose path is its entry of the
    manifest: range=R/first=F/n_ids=N, F the ids before it in its range. Spark
    writes the bytes as a text file of one line, so any store that Spark writes
    will do; the line's end is no part of the format. Ranges of the key come
    from its quantiles, and a key that fills several of them is dealt to these
    by its ids; within a range a task streams its sorted rows and closes a file
    at FILE_IDS ids, so no task holds a range. Null keys come first, equal keys
    in a fixed order.
    """
    from .tokenization import words_of

    null = -(1 << 63)
    k = F.col(key).cast("long")
    n = docs.count()
    cuts = max(1, min(MOST_RANGES, -(-n // RANGE_DOCS)))
    bounds = docs.agg(F.percentile_approx(F.coalesce(k, F.lit(null)), [i / cuts for i in range(1, cuts)], 10 * cuts).alias("b")).first()["b"] if cuts > 1 else []
    bounds = np.array(sorted(bounds or []), np.int64)

    def coded(batches):
        words = words_of(vocabulary)
        for whole in batches:
            for batch in sliced(whole):
                keys = batch.column(0)
                found = [x + b"\x01\x00" for x in words.encode(batch.column(1).to_pylist())]
                plain = np.asarray(keys.fill_null(null))
                low, high = np.searchsorted(bounds, plain, side="left"), np.searchsorted(bounds, plain, side="right")
                ranges = low + np.array([zlib.crc32(x) for x in found], np.int64) % (high - low + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), keys, pa.array(found, pa.binary())], ["range", "key", "ids"])

    def files(batches):
        keys: list = []
        held: list[np.ndarray] = []
        now, first, size = None, 0, 0

        def closed():
            columns = ([now], [first], [size], [write_file(keys, held)])
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["range", "first", "n_ids", "data"])

        for batch in batches:
            for r, d, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (r != now or size >= FILE_IDS):
                    yield closed()
                    first = first + size if r == now else 0
                    keys, held, size = [], [], 0
                now = r
                keys.append(d)
                held.append(np.frombuffer(ids, np.uint16))
                size += len(held[-1])
        if held:
            yield closed()

    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cuts // 8))
    given = docs.select(k.alias("key"), F.col(text).cast("string").alias("text"))
    rows = given.mapInArrow(lean(coded), "range int, key long, ids binary").repartition(width, "range").sortWithinPartitions("range", F.col("key").asc_nulls_first(), "ids")
    made = rows.mapInArrow(lean(files), "range int, first long, n_ids long, data binary")
    made.select("range", "first", "n_ids", F.col("data").cast("string").alias("value")).write.partitionBy("range", "first", "n_ids").text(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files at path, per document: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32, and with_ids the ids. A path
    without files gives no rows.

    A range's first id is the sum over the ranges before it (one number per
    range, at most MOST_RANGES of them, from the paths alone); within a range
    each file's path says where it begins. Files are decoded where they are read.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").load(path)
    if "range" not in files.columns:
        return spark.createDataFrame([], schema)
    totals = files.groupBy(F.col("range").cast("int").alias("range")).agg(F.max(F.col("first").cast("long") + F.col("n_ids").cast("long")).alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(totals):
        starts[r["range"]] = total
        total += r["n"]

    def rows(batches):
        for batch in batches:
            for r, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys, documents = read_file(data.as_py())
                sizes = np.array([len(d) for d in documents], np.int64)
                begins = starts[r] + first + np.cumsum(sizes) - sizes
                documents = [d.astype("<u4") for d in documents]
                columns = [pa.array(keys, pa.int64()), pa.array(begins), pa.array(sizes), pa.array([zlib.crc32(d) for d in documents], pa.int64())]
                if with_ids:
                    columns.append(pa.array([d.view(np.int32) for d in documents], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return files.select(F.col("range").cast("int"), F.col("first").cast("long"), "content").mapInArrow(lean(rows), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .packing import vocabulary

    path = stash_path(spark, "ids")
    write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    digests = pinned(read(spark, path, with_ids=False))
    drop_path(spark, path)  # the digests are kept; the files have been read back
    return digests
