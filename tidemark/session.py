"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Enough for a local master and for clusters that install the repository at
    the same path on every machine; otherwise submit it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the one that driver and executors share
    (``spark.checkpoint.dir``); without one, only a local master will do."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
    return f"{(found or tempfile.gettempdir()).rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def local_session(cores: str = "8", memory: str = "8g", shuffles: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffles))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
