"""Deterministic views over the test tables, in Spark and in SQL.

``events`` becomes an event log whose transactions hold three events each, cut
by a tick at every 100th event. Every 17th transaction of a tick's last 40 is
still running when it is taken, so its events come with a later batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import url_row

EVERY, PER_TX, FIRST_TX, LATE, STRIDE = 100, 3, 1000, 40, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its times without zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(times) if times else df


def evlog_type():
    """The type that an event of the log has by its payload."""
    kind = F.regexp_extract("ev_data", "event_type=([a-z]+)", 1)
    return F.concat(F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U"), F.lit(":user_id"))


def evlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("ev_id"),
        F.col("ts").alias("ev_time"),
        (FIRST_TX + F.expr(f"event_id div {PER_TX}")).alias("ev_txid"),
        F.lit(None).cast("int").alias("ev_owner"),
        F.lit(None).cast("int").alias("ev_retry"),
        F.concat(op, F.lit(":user_id")).alias("ev_type"),
        url_row({"user_id": F.col("user_id").cast("string"), "event_type": F.col("event_type"), "value": F.format_string("%.2f", "value"), "props": F.col("props")}).alias("ev_data"),
        F.lit("public.users").alias("ev_extra1"),
        null.alias("ev_extra2"),
        null.alias("ev_extra3"),
        null.alias("ev_extra4"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tick, from every EVERY-th event; tick 0 has seen nothing."""
    e = table(spark, sf_dir, "events")
    cut = e.where(f"(event_id + 1) % {EVERY} = 0").select(((F.col("event_id") + 1) / EVERY).cast("long").alias("k"), F.col("ts").alias("tick_time"))
    zero = e.where("event_id = 0").select(F.lit(0).cast("long").alias("k"), F.col("ts").alias("tick_time"))
    xmax = FIRST_TX + F.expr(f"{EVERY} * k div {PER_TX}")
    a = zero.union(cut).select("k", "tick_time", xmax.alias("xmax"))
    xip = F.filter(F.sequence(F.greatest(F.col("xmax") - LATE, F.lit(FIRST_TX)), F.col("xmax")), lambda t: (t % STRIDE == 0) & (t < F.col("xmax")))
    b = a.select("*", xip.cast("array<bigint>").alias("xip"))
    snap = F.struct(F.coalesce(F.try_element_at("xip", F.lit(1)), F.col("xmax")).alias("xmin"), "xmax", "xip")
    return b.select(F.lit(1).alias("tick_queue"), F.col("k").alias("tick_id"), "tick_time", snap.alias("tick_snapshot"), (F.col("k") * EVERY).alias("tick_event_seq"))


SQL = f"""
  evlog AS (
    SELECT event_id + 1 AS ev_id, ts AS ev_time, {FIRST_TX} + event_id // {PER_TX} AS ev_txid,
           CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, user_id, event_type, value, props
    FROM events),
  ticks AS (
    SELECT (event_id + 1) // {EVERY} AS tick_id, ts AS tick_time FROM events WHERE (event_id + 1) % {EVERY} = 0
    UNION ALL SELECT 0, ts FROM events WHERE event_id = 0),
  tk AS (SELECT tick_id, tick_time, {EVERY} * tick_id AS tick_event_seq, {FIRST_TX} + {EVERY} * tick_id // {PER_TX} AS xmax FROM ticks),
  batched AS (
    SELECT e.*, (SELECT min(t.tick_id) FROM tk t WHERE e.ev_txid < t.xmax
                 AND NOT (e.ev_txid % {STRIDE} = 0 AND e.ev_txid >= t.xmax - {LATE})) AS batch_tick
    FROM evlog e)"""
