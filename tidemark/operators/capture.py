"""Row changes as typed events: what a trigger would have written between two
versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import quote_ident, quote_literal, url_row


def diff(old: DataFrame, new: DataFrame, key: list[str], ignore: tuple[str, ...] = (), when: str | None = None) -> DataFrame:
    """Per changed key: op, structs ``o`` and ``n`` (null where there is no row).

    A row that differs in ignored columns only is no change. when: a SQL
    predicate over the changed row (the new one, the old for deletes); null is
    an error.
    """
    cols = [c for c in new.columns if c not in ignore]
    pack = lambda d, a: d.select(*key, F.struct(*d.columns).alias(a))
    j = pack(old, "o").join(pack(new, "n"), key, "full")
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    op = F.when(F.col("o").isNull(), "I").when(F.col("n").isNull(), "D").when(changed, "U")
    out = j.select(*key, op.alias("op"), "o", "n").where("op is not null")
    if when:
        row = out.select("*", F.when(F.col("op") == "D", F.col("o")).otherwise(F.col("n")).alias("__r"))
        fields = row.select("*", *(F.col(f"__r.{c}").alias(f"__w_{c}") for c in new.columns))
        named = fields.select(F.struct("op", "o", "n").alias("__k"), *(F.col(k).alias(f"__k_{k}") for k in key), *(F.col(f"__w_{c}").alias(c) for c in new.columns))
        test = F.expr(when)
        named = named.where(F.when(test.isNull(), F.raise_error("when is null").cast("boolean")).otherwise(test))
        out = named.select(*(F.col(f"__k_{k}").alias(k) for k in key), "__k.op", "__k.o", "__k.n")
    return out


def _text(c: Column) -> Column:
    return c.cast("string")


def url_events(changes: DataFrame, key: list[str], columns: list[str], ignore: tuple[str, ...] = (), backup: bool = False) -> DataFrame:
    """ev_type ``U:a,b`` and the row url-encoded (the old row for deletes);
    with backup the old row in ev_extra2."""
    cols = [c for c in columns if c not in ignore]
    row = lambda s: url_row({c: _text(F.col(f"{s}.{c}")) for c in cols})
    out = [F.concat(F.col("op"), F.lit(":" + ",".join(key))).alias("ev_type"), F.when(F.col("op") == "D", row("o")).otherwise(row("n")).alias("ev_data")]
    if backup:
        out.append(F.when(F.col("op") != "I", row("o")).alias("ev_extra2"))
    return changes.select(*key, *out)


def sql_events(changes: DataFrame, key: list[str], columns: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """ev_type I, U or D and partial SQL: ``(a,b) values (1,'x')``, changed
    columns ``b='y' where a='1'``, or ``a='1'``. An update without a change
    sets its first key column to itself."""
    cols = [c for c in columns if c not in ignore]
    lit = lambda s, c: quote_literal(_text(F.col(f"{s}.{c}")))
    name = lambda c: quote_ident(F.lit(c))
    insert = F.concat(F.lit("("), F.concat_ws(",", *(name(c) for c in cols)), F.lit(") values ("), F.concat_ws(",", *(lit("n", c) for c in cols)), F.lit(")"))
    where = lambda s: F.concat_ws(" and ", *(F.concat(name(c), F.lit("="), lit(s, c)) for c in key))
    sets = F.concat_ws(",", *(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.concat(name(c), F.lit("="), lit("n", c))) for c in cols if c not in key))
    sets = F.when(sets == "", F.concat(name(key[0]), F.lit("="), lit("n", key[0]))).otherwise(sets)
    data = F.when(F.col("op") == "I", insert).when(F.col("op") == "U", F.concat(sets, F.lit(" where "), where("o"))).otherwise(where("o"))
    return changes.select(*key, F.col("op").alias("ev_type"), data.alias("ev_data"))


def overridden(events: DataFrame, **fields: str) -> DataFrame:
    """Event fields replaced by SQL expressions over the event's row."""
    return events.select("*", *(F.expr(v).alias(f"__f_{k}") for k, v in fields.items())).withColumns({k: F.col(f"__f_{k}") for k in fields}).drop(*(f"__f_{k}" for k in fields))


def denied(changes: DataFrame, table: str) -> DataFrame:
    """A table that may not change: any change is an error."""
    return changes.where(F.raise_error(f"changes on {table} are not allowed").cast("boolean"))


def kinds(columns: list[str], kind: str) -> tuple[list[str], list[str]]:
    """(key columns, other columns) by one letter per column: k, v or i; columns
    beyond the text are ignored, a key is required."""
    pairs = list(zip(columns, kind, strict=False))
    key = [c for c, k in pairs if k == "k"]
    if not key or set(kind) - set("kvi"):
        raise ValueError(f"bad column kinds: {kind!r}")
    return key, [c for c, k in pairs if k == "v"]
