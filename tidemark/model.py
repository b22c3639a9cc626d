"""The data model: events, ticks, snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_SCHEMA = "ev_id long, ev_time timestamp, ev_txid long, ev_owner int, ev_retry int, ev_type string, ev_data string, ev_extra1 string, ev_extra2 string, ev_extra3 string, ev_extra4 string"
SNAPSHOT = "struct<xmin:bigint,xmax:bigint,xip:array<bigint>>"
TICK_SCHEMA = f"tick_queue int, tick_id long, tick_time timestamp, tick_snapshot {SNAPSHOT}, tick_event_seq long"


def visible(txid: Column, snap: Column) -> Column:
    """Had the transaction ended when the snapshot was taken?"""
    return (txid < snap["xmin"]) | ((txid < snap["xmax"]) & ~F.array_contains(snap["xip"], txid))


def parse_snapshot(text: Column) -> Column:
    """``xmin:xmax:a,b,c`` as a struct; a malformed one is an error, null stays null.

    0 < xmin < xmax, or xmin = xmax without running transactions; those rise
    strictly and lie in [xmin, xmax).
    """
    part = F.split(text, ":")
    xmin, xmax = (F.try_element_at(part, F.lit(i)).try_cast("bigint") for i in (1, 2))
    ids = F.try_element_at(part, F.lit(3))
    xip = F.when(ids == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(ids, ","), lambda x: x.try_cast("bigint")))
    rising = F.forall(F.transform(xip, lambda x, i: F.when(i == 0, True).otherwise(x > F.get(xip, i - 1))), lambda x: F.coalesce(x, F.lit(False)))
    inside = F.forall(xip, lambda x: F.coalesce((x >= xmin) & (x < xmax), F.lit(False)))
    good = F.coalesce((F.size(part) == 3) & (xmin > 0) & (xmin <= xmax) & rising & inside, F.lit(False))
    made = F.struct(xmin.alias("xmin"), xmax.alias("xmax"), xip.alias("xip"))
    return F.when(text.isNull(), F.lit(None).cast(SNAPSHOT)).when(good, made).otherwise(F.raise_error(F.concat(F.lit("bad snapshot: "), text)).cast(SNAPSHOT))


def format_snapshot(snap: Column) -> Column:
    return F.concat_ws(":", snap["xmin"].cast("string"), snap["xmax"].cast("string"), F.array_join(F.transform(snap["xip"], lambda x: x.cast("string")), ","))


def snapshot(xmin: int, xmax: int, xip: list[int]) -> Column:
    return F.struct(F.lit(xmin).cast("bigint").alias("xmin"), F.lit(xmax).cast("bigint").alias("xmax"), F.array(*map(F.lit, xip)).cast("array<bigint>").alias("xip"))
