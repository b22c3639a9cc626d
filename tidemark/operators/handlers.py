"""Table handlers: what happens to one table's events on their way to a copy.

A handler turns a DataFrame of events (ev_id, ev_time, ev_type, ev_data,
ev_extra1…) into another, or into changes for a target table. Each is a plan
over all events of its table; a subclass is a plug-in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import url_map
from . import fold
from .registry import handler_arguments


def local_only(events: DataFrame, tables: DataFrame, control: tuple[str, ...]) -> DataFrame:
    """Control events (of types with those prefixes), and those of the tables (table_name) that are local."""
    control = F.exists(F.array(*map(F.lit, control)), lambda p: F.startswith("ev_type", p))
    mine = tables.select(F.col("table_name").alias("ev_extra1"), F.lit(True).alias("__mine")).distinct()
    return events.join(mine, "ev_extra1", "left").where(control | F.col("__mine")).select(*events.columns)


def of_types(events: DataFrame, letters: str) -> DataFrame:
    """Row changes of some kinds only; letters other than I, U and D are an error."""
    bad = set(letters) - set("IUD")
    if bad or not letters:
        raise ValueError(f"bad event types: {letters!r}")
    return events.where(fold.op_of(F.col("ev_type")).isin(list(letters)))


def valid_event(ev_type: Column) -> Column:
    """An event's type, of a row change with key columns; others are an error."""
    return F.when(ev_type.rlike("^[IUD]:."), ev_type).otherwise(F.raise_error(F.concat(F.lit("unsupported event: "), F.coalesce(ev_type, F.lit("null")))).cast("string"))


def hash_of(extra: Column) -> Column:
    """N of ``hash=N`` in a url-encoded field; null without one."""
    return F.try_element_at(url_map(extra), F.lit("hash")).try_cast("long")


@dataclass
class Handler:
    """Applies events as they are. table: its name on the target."""

    table: str
    arguments: dict[str, str] = field(default_factory=dict)
    #: Arguments that a handler takes; others are an error.
    takes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        unknown = set(self.arguments) - set(self.takes)
        if unknown:
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")

    def events(self, events: DataFrame) -> DataFrame:
        """The events that the table takes, in any order."""
        return events

    def copy_condition(self) -> Column:
        """Which rows of the source the first copy takes."""
        return F.lit(True)

    def apply(self, base: DataFrame, events: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
        """The table after the events; columns beside the key, as text."""
        m = url_map(F.col("ev_data"))
        taken = self.events(events).select("ev_id", fold.op_of(valid_event(F.col("ev_type"))).alias("op"), m.alias("m"))
        types = dict(base.dtypes)
        changes = taken.select("ev_id", "op", *(F.try_element_at("m", F.lit(c)).try_cast(types[c]).alias(c) for c in [*key, *columns]))
        return fold.apply_changes(base, fold.net_change(changes, key, columns), key, columns)


class Ignore(Handler):
    """Takes no events (a virtual table, or one that is only pretended to be local)."""

    def events(self, events: DataFrame) -> DataFrame:
        return events.where(F.lit(False))


class Shard(Handler):
    """Takes what its shard has: hash & mask = nr, the hash from ``hash=N`` in
    ev_extra3; an event without one is every shard's."""

    takes = ("hash_key", "mask", "nr", "hashexpr")

    def __init__(self, table: str, arguments: dict[str, str]):
        super().__init__(table, arguments, self.takes)
        if "hash_key" not in arguments:
            raise ValueError("hash_key is needed")
        self.mask, self.nr = int(arguments["mask"]), int(arguments["nr"])

    def events(self, events: DataFrame) -> DataFrame:
        return events.where(fold.in_shard(hash_of(F.col("ev_extra3")), self.mask, self.nr))

    def copy_condition(self) -> Column:
        """By hashexpr, SQL over the source's row."""
        return F.expr(self.arguments.get("hashexpr", self.arguments["hash_key"])).bitwiseAND(F.lit(self.mask)) == self.nr


class Dispatch(Handler):
    """Deals events to partition tables by time; ``part`` names them."""

    takes = ("period", "part_mode", "part_field", "row_mode", "event_types", "keep", "skip")

    def __init__(self, table: str, arguments: dict[str, str]):
        super().__init__(table, arguments, self.takes)

    def part(self, batch_end: Column | None = None, now: Column | None = None) -> Column:
        mode, period = self.arguments.get("part_mode", "event_time"), self.arguments.get("period", "day")
        if mode == "date_field":
            text = F.try_element_at(url_map(F.col("ev_data")), F.lit(self.arguments["part_field"]))
            at = F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd HH:mm:ss")
        else:
            at = {"event_time": F.col("ev_time"), "batch_time": batch_end, "current_time": now}[mode]
        return fold.partition_name(F.lit(self.table), at, period)

    def events(self, events: DataFrame) -> DataFrame:
        kept = of_types(events, self.arguments.get("event_types", "IUD").replace("|", ""))
        return kept

    def dealt(self, events: DataFrame, batch_end: Column | None = None, now: Column | None = None, oldest: str | None = None) -> DataFrame:
        """Events with op and part. oldest: events of partitions named before it
        (obsolete ones) are left out."""
        rows = self.events(events).select("*", fold.op_of(F.col("ev_type")).alias("op"), self.part(batch_end, now).alias("part"))
        rows = fold.row_mode(rows, self.arguments.get("row_mode", "keep_latest"))
        return rows if oldest is None else rows.where(F.col("part") >= oldest)


HANDLERS: dict[str, type[Handler] | Callable[[str, dict[str, str]], Handler]] = {"default": Handler, "vtable": Ignore, "fake_local": Ignore, "qtable": Ignore, "shard": Shard, "dispatch": Dispatch}


def handler(spec: str, table: str) -> Handler:
    """The handler that ``name(argument=value&…)`` names."""
    name, arguments = handler_arguments(spec)
    if name not in HANDLERS:
        raise ValueError(f"no such handler: {name}")
    return HANDLERS[name](table, arguments)


def load(base: DataFrame, changes: DataFrame, key: list[str], payload: list[str], method: str = "correct") -> DataFrame:
    """base after net changes by a loading method. ``correct`` updates rows that
    are there; ``delete`` and ``merged`` delete and insert, so an update of a
    missing row inserts it; ``insert`` takes inserts only, as they come."""
    if method == "insert":
        return fold.apply_insert_only(base, changes, key, payload)
    net = fold.net_change(changes, key, payload)
    if method in ("delete", "merged"):
        net = net.withColumn("op", F.when(F.col("op") == "U", "I").otherwise(F.col("op")))
    elif method != "correct":
        raise ValueError(f"unknown method: {method}")
    return fold.apply_changes(base, net, key, payload)


def mismatches(base: DataFrame, changes: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Per operation of the net changes: how many, and how many met a row (op, expected, met)."""
    net = fold.net_change(changes, key, payload).select(*key, "op")
    there = base.select(*key, F.lit(True).alias("__there")).distinct()
    return net.join(there, key, "left").groupBy("op").agg(F.count("*").alias("expected"), F.count("__there").alias("met"))


def with_parents(changes: DataFrame, parents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Changes whose parent row is there; columns: of the change to of the parent."""
    p = parents.select(*(F.col(b).alias(a) for a, b in columns.items())).distinct()
    return changes.join(p, list(columns), "left_semi")


def per_event(events: DataFrame, expressions: dict[str, str], meta: str = "event.") -> DataFrame:
    """SQL expressions over each event: ``data`` is its decoded row with the
    event's own fields under a prefix (``data['event.ev_id']``)."""
    own = [c for c in events.columns if c != "ev_data"]
    more = F.map_from_arrays(F.array(*(F.lit(meta + c) for c in own)), F.array(*(F.col(c).cast("string") for c in own)))
    rows = events.select("*", F.map_concat(url_map(F.coalesce("ev_data", F.lit(""))), more).alias("data"))
    return rows.select("ev_id", *(F.expr(e).alias(n) for n, e in expressions.items()))
