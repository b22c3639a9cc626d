"""Change events folded into net changes and applied to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def op_of(ev_type: Column) -> Column:
    return F.substring(ev_type, 1, 1)


def keys_of(ev_type: Column) -> Column:
    """Key columns named by ``I:a,b``; empty where there are none."""
    rest = F.substring(ev_type, 3, 1 << 20)
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))


def net_change(changes: DataFrame, key: list[str], payload: list[str], order: str = "ev_id", op: str = "op") -> DataFrame:
    """Per key the one change that its I/U/D history amounts to, with the last
    event's payload; histories that cancel out are gone.

    The row was there before unless the first event is I, and is there after
    unless the last I or D is a D. Both are order-insensitive aggregates, so
    each task folds its own events before anything is shuffled, and a hot key
    costs one row per task.
    """
    known = F.when(F.col(op).isin("I", "U", "D"), F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))).cast("string"))
    a = changes.select(*key, order, known.alias("op"), *payload)
    last = F.max_by(F.struct("op", *payload), order)
    g = a.groupBy(*key).agg(F.min_by("op", order).alias("first_op"), F.max_by("op", F.when(F.col("op") != "U", F.col(order))).alias("last_id"), last.alias("last"), F.max(order).alias(order))
    before, after = F.col("first_op") != "I", F.coalesce(F.col("last_id") != "D", F.lit(True))
    net = F.when(before & after, "U").when(before, "D").when(after, "I")
    return g.select(*key, net.alias("op"), order, *(F.col(f"last.{p}").alias(p) for p in payload)).where("op is not null")


def apply_changes(base: DataFrame, net: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """base after net changes: I adds or replaces, U replaces where the row is,
    D removes. One join on the key; a change of a missing row does nothing."""
    n = net.select(*key, F.col("op").alias("__op"), *(F.col(p).alias(f"__n_{p}") for p in payload))
    b = base.withColumn("__there", F.lit(True))
    joined = b.join(n, key, "full")
    there = F.coalesce("__there", F.lit(False))
    keep = F.when(F.col("__op").isNull(), there).when(F.col("__op") == "D", False).when(F.col("__op") == "U", there).otherwise(True)
    return joined.where(keep).select(*key, *(F.when(F.col("__op").isin("I", "U"), F.col(f"__n_{p}")).otherwise(F.col(p)).alias(p) for p in payload))


def apply_insert_only(base: DataFrame, net: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """base with inserts; anything else is an error."""
    checked = F.when(F.col("op") == "I", True).otherwise(F.raise_error("only inserts may be applied").cast("boolean"))
    return base.select(*key, *payload).unionByName(net.where(checked).select(*key, *payload))


def row_mode(changes: DataFrame, mode: str) -> DataFrame:
    """plain as it is; keep_latest turns an update into delete and insert;
    keep_all turns it into an insert and drops deletes."""
    if mode == "plain":
        return changes
    if mode == "keep_all":
        return changes.where("op <> 'D'").withColumn("op", F.lit("I"))
    if mode == "keep_latest":
        ops = F.when(F.col("op") == "U", F.array(F.lit("D"), F.lit("I"))).otherwise(F.array(F.col("op")))
        return changes.withColumn("op", F.explode(ops))
    raise ValueError(f"unknown row mode: {mode}")


#: date_format patterns of partition names, by period.
PERIODS = {"year": "yyyy", "month": "yyyy_MM", "day": "yyyy_MM_dd", "hour": "yyyy_MM_dd_HH"}


def partition_name(parent: Column, at: Column, period: str) -> Column:
    """``parent_2024_01_31``; a null time is an error."""
    text = F.date_format(at, PERIODS[period])
    return F.concat_ws("_", parent, F.coalesce(text, F.raise_error("no partition time").cast("string")))


def partition_bounds(at: Column, period: str) -> Column:
    lo = F.date_trunc(period, at)
    step = {"year": F.make_interval(years=F.lit(1)), "month": F.make_interval(months=F.lit(1)), "day": F.make_interval(days=F.lit(1)), "hour": F.make_interval(hours=F.lit(1))}[period]
    return F.struct(lo.alias("lower"), (lo + step).alias("upper"))


def obsolete(name: Column, parent: str, period: str, cutoff: Column) -> Column:
    """Is a partition older than the cutoff? By name, as text; null where the
    name isn't one of the parent's."""
    shape = {"year": r"\d{4}", "month": r"\d{4}_\d\d", "day": r"\d{4}_\d\d_\d\d", "hour": r"\d{4}_\d\d_\d\d_\d\d"}[period]
    return F.when(name.rlike(f"^{parent}_{shape}$"), name < F.concat(F.lit(f"{parent}_"), F.date_format(cutoff, PERIODS[period])))


PRESETS = {
    f"{load}{period}_{source}": {"table_mode": "part", "row_mode": "keep_latest", "load_mode": "bulk" if load else "direct", "period": unit, "part_mode": part}
    for load in ("", "bulk_")
    for period, unit in (("hourly", "hour"), ("daily", "day"), ("monthly", "month"), ("yearly", "year"))
    for source, part in (("event", "event_time"), ("batch", "batch_time"), ("field", "date_field"), ("time", "current_time"))
} | {"bulk_direct": {"table_mode": "direct", "row_mode": "plain", "load_mode": "bulk"}, "direct": {"table_mode": "direct", "row_mode": "plain", "load_mode": "direct"}}


def in_shard(hashed: Column, mask: int, nr: int) -> Column:
    """A row without a hash belongs to every shard."""
    return hashed.isNull() | (hashed.bitwiseAND(F.lit(mask)) == nr)


def map_fields(data: Column, keep: dict[str, str], skip: tuple[str, ...] = ()) -> Column:
    """A payload map with fields kept and renamed; a missing one is null."""
    kept = {a: b for a, b in keep.items() if a not in skip}
    return F.map_from_arrays(F.array(*map(F.lit, kept.values())), F.array(*(F.try_element_at(data, F.lit(a)) for a in kept)))


def map_keys(keys: Column, keep: dict[str, str]) -> Column:
    names = F.create_map(*(F.lit(x) for kv in keep.items() for x in kv))
    return F.filter(F.transform(keys, lambda k: F.try_element_at(names, k)), lambda k: k.isNotNull())


def after_truncate(events: DataFrame) -> DataFrame:
    """Events of each table after its last truncation (R), which they outlive."""
    cut = events.where("ev_type = 'R'").groupBy("ev_extra1").agg(F.max("ev_id").alias("__cut"))
    return events.join(cut, "ev_extra1", "left").where("ev_type <> 'R' and (__cut is null or ev_id > __cut)").drop("__cut")


def newest_wins(changes: DataFrame, base: DataFrame, key: list[str], stamp: str, payload: list[str]) -> DataFrame:
    """base after changes (op I or U), each taken only if its stamp is later
    than the row's; equal stamps keep what was there first."""
    best = changes.groupBy(*key).agg(F.max_by(F.struct(stamp, *payload), F.struct(F.col(stamp), -F.col("ev_id"))).alias("n"))
    b = base.select(*key, F.col(stamp).alias("__b"), *(F.col(p).alias(f"__b_{p}") for p in payload), F.lit(True).alias("__there"))
    j = b.join(best, key, "full")
    new = F.col("n").isNotNull() & (F.col("__there").isNull() | F.coalesce(F.col(f"n.{stamp}") > F.col("__b"), F.lit(False)))
    pick = lambda a, c: F.when(new, F.col(f"n.{a}")).otherwise(F.col(c)).alias(a)
    return j.select(*key, pick(stamp, "__b"), *(pick(p, f"__b_{p}") for p in payload))
