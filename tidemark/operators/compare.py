"""Two copies of a table compared, and the statements that would repair one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import quote_ident, quote_literal


def common_columns(a: list[str], b: list[str], key: list[str]) -> list[str]:
    """Columns of both in a's order, the key first; none or a missing key is an error."""
    both = [c for c in a if c in b]
    if not both or any(k not in both for k in key):
        raise ValueError("the tables share no columns or lack the key")
    return [*key, *(c for c in both if c not in key)]


def row_text(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))


def checksum(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """(cnt, chk): rows and the sum of the rows' hashes, whatever their order."""
    rows = df.where(F.expr(where)) if where else df
    return rows.agg(F.count("*").alias("cnt"), F.coalesce(F.sum(F.xxhash64(row_text(columns)).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("chk"))


def md5_checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cnt, chk): the sum of the first 60 bits of the rows' MD5 sums."""
    h = F.conv(F.substring(F.md5(row_text(columns)), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("cnt"), F.sum(h).cast("decimal(38,0)").alias("chk"))


def same_value(a: Column, b: Column) -> Column:
    """Equal, or equal texts but for a zone suffix of three characters that one of them has."""
    s = lambda x, y: (F.length(y) >= 19) & (F.length(x) == F.length(y) + 3) & (F.substring(x, 1, 1 << 20).startswith(y)) & F.substring(x, -3, 3).rlike(r"^[+-]\d\d$")
    return a.eqNullSafe(b) | F.coalesce(s(a, b) | s(b, a), F.lit(False))


def differences(src: DataFrame, dst: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Per key that differs: op (insert, update, delete into dst) and the names
    of the columns that differ. Values compare as text."""
    rest = [c for c in columns if c not in key]
    pack = lambda d, p: d.select(*key, *(F.col(c).cast("string").alias(f"{p}_{c}") for c in rest), F.lit(True).alias(p))
    j = pack(src, "s").join(pack(dst, "d"), key, "full")
    names = F.filter(F.array(*(F.when(~same_value(F.col(f"s_{c}"), F.col(f"d_{c}")), F.lit(c)) for c in rest)), lambda x: x.isNotNull()) if rest else F.array().cast("array<string>")
    op = F.when(F.col("d").isNull(), "insert").when(F.col("s").isNull(), "delete").when(F.size(names) > 0, "update")
    return j.select("*", op.alias("op"), names.alias("changed")).where("op is not null")


def repair_sql(src: DataFrame, dst: DataFrame, table: str, key: list[str], columns: list[str]) -> DataFrame:
    """One statement per difference. Updates set what differs and are guarded by
    the old values, so that a row changed since is left alone."""
    rest = [c for c in columns if c not in key]
    d = differences(src, dst, key, columns)
    ident = lambda c: quote_ident(F.lit(c))
    is_key = F.concat_ws(" and ", *(F.concat(ident(c), F.lit(" = "), quote_literal(F.col(c).cast("string"))) for c in key))
    insert = F.concat(F.lit(f"insert into {table} ("), F.concat_ws(", ", *(ident(c) for c in columns)), F.lit(") values ("), F.concat_ws(", ", *(quote_literal(F.col(c).cast("string")) for c in key), *(quote_literal(F.col(f"s_{c}")) for c in rest)), F.lit(");"))
    hit = lambda c, x: F.when(F.array_contains("changed", c), x)
    sets = F.concat_ws(", ", *(hit(c, F.concat(ident(c), F.lit(" = "), quote_literal(F.col(f"s_{c}")))) for c in rest))
    guard = F.concat_ws(" and ", is_key, *(hit(c, F.when(F.col(f"d_{c}").isNull(), F.concat(ident(c), F.lit(" is null"))).otherwise(F.concat(ident(c), F.lit(" = "), quote_literal(F.col(f"d_{c}"))))) for c in rest))
    sql = F.when(F.col("op") == "insert", insert).when(F.col("op") == "update", F.concat(F.lit(f"update only {table} set "), sets, F.lit(" where "), guard, F.lit(";"))).otherwise(F.concat(F.lit(f"delete from only {table} where "), is_key, F.lit(";")))
    return d.select(*key, "op", sql.alias("sql"))


def pivot_last(rows: DataFrame, keys: list[str], name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """Long to wide: one row per key, of each name the last value in order."""
    return rows.groupBy(*keys).pivot(name, names).agg(F.max_by(value, order))


def stat_sums(lines: DataFrame, column: str) -> DataFrame:
    """(key, total, whole) over lines ``{k: 1, k2: 2.5}``: sums per key, exact;
    whole if no value had a decimal point."""
    pairs = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"([\w.-]+: -?[0-9.]+)"), F.lit(1))).alias("p"))
    number = F.substring_index("p", ": ", -1)
    return pairs.groupBy(F.substring_index("p", ": ", 1).alias("key")).agg(F.sum(number.cast("decimal(28,6)")).alias("total"), ~F.bool_or(F.contains(number, F.lit("."))).alias("whole"))


def records_by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key its records, in a fixed order."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys)))).alias("records"))
