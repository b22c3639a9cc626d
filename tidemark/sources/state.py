"""A small versioned table: consumer positions, ledgers, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class State:
    """Every save writes a new version folder whole; a version counts once its
    writer has committed it, so a crashed save is as if it had never begun."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[2:]) for n in names if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def load(self) -> DataFrame:
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{found[-1]}")

    def save(self, rows: DataFrame) -> int:
        nr = (self._versions() or [0])[-1] + 1
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(f"{self.path}/v-{nr}")
        return nr

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the newest versions: readers of the one before may still be at work."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for nr in self._versions()[:-keep]:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v-{nr}")
            old.getFileSystem(conf).delete(old, True)

    def upsert(self, rows: DataFrame, key: list[str]) -> int:
        old = self.load().join(rows.select(*key), key, "left_anti")
        return self.save(old.unionByName(rows))


def advance(state: State, consumer: str, tick: int) -> bool:
    """Moves a consumer's position (consumer, last_tick) on; never back. False if it was there."""
    now = state.load().where(F.col("consumer") == consumer).select("last_tick").first()
    if now is not None and now["last_tick"] >= tick:
        return False
    state.upsert(state.spark.createDataFrame([(consumer, tick)], "consumer string, last_tick long"), ["consumer"])
    return True
