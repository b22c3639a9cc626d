"""Reading and writing event logs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_SCHEMA


def numbered(events: DataFrame, last_id: int, now=None) -> DataFrame:
    """events with an ev_id where they have none, from last_id on, and a time.

    Numbers rise within each task's rows and differ everywhere, with gaps, as a
    sequence's do; so no task needs to know how many rows the others have.
    """
    own = F.monotonically_increasing_id() + F.lit(last_id + 1)
    given = {c: (F.col(c) if c in events.columns else F.lit(None)) for c in ("ev_id", "ev_time")}
    return events.withColumns({"ev_id": F.coalesce(given["ev_id"].cast("long"), own), "ev_time": F.coalesce(given["ev_time"].cast("timestamp"), F.current_timestamp() if now is None else now)})


def append_events(events: DataFrame, path: str, rotation: int = 0, most_per_tx: int | None = None, open_: bool = True) -> None:
    """Appends to a log partitioned by rotation number, missing fields null.
    most_per_tx: a transaction with more events is an error, as is any insert
    into a queue that isn't open."""
    if not open_:
        raise ValueError("the queue takes no events")
    names = [x.strip().split()[0] for x in EVENT_SCHEMA.split(",")]
    types = dict(x.strip().split() for x in EVENT_SCHEMA.split(","))
    rows = events.select(*((F.col(n) if n in events.columns else F.lit(None)).cast(types[n]).alias(n) for n in names))
    if most_per_tx is not None:
        over = rows.groupBy("ev_txid").count().where(F.col("count") > most_per_tx).limit(1).collect()
        if over:
            raise ValueError(f"transaction {over[0]['ev_txid']} has over {most_per_tx} events")
    rows.withColumn("rotation_nr", F.lit(rotation)).write.mode("append").partitionBy("rotation_nr").parquet(path)


def read_events(spark: SparkSession, path: str, rotations: list[int] | None = None) -> DataFrame:
    log = spark.read.schema(f"{EVENT_SCHEMA}, rotation_nr int").parquet(path)
    return log.where(F.col("rotation_nr").isin(rotations)) if rotations is not None else log


def copy_table(src: DataFrame, path: str, columns: list[str] | None = None, where: str | None = None, rename: dict[str, str] | None = None) -> int:
    """Writes a filtered, renamed selection; returns the rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = src.where(where) if where else src
    named = rows.select(*(F.col(c).alias((rename or {}).get(c, c)) for c in columns or src.columns))
    named.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def split_queue(events: DataFrame, path: str, field: str = "ev_extra1") -> None:
    """One folder per value of the field."""
    events.withColumn("queue", F.col(field)).write.mode("append").partitionBy("queue").parquet(path)


def split_events(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`split_queue` has written, with the queue of each event."""
    return spark.read.schema(f"{EVENT_SCHEMA}, queue string").parquet(path)


def moved(events: DataFrame, last_id: int = 0, table: str | None = None) -> DataFrame:
    """Events for another queue: type, data and extra fields as they were, new
    ids there. table: only that table's events."""
    rows = events if table is None else events.where(F.col("ev_extra1") == table)
    kept = ("ev_type", "ev_data", "ev_extra1", "ev_extra2", "ev_extra3", "ev_extra4")
    return numbered(rows.orderBy("ev_id").select("ev_time", *kept), last_id)


def walk(batch: DataFrame, fetch: int = 300):
    """A batch's events in order, fetched a few at a time; one pass."""
    import itertools

    rows = batch.orderBy("ev_id").toLocalIterator(prefetchPartitions=True)
    while some := list(itertools.islice(rows, fetch)):
        yield from some


def copy_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """COPY lines (value): fields quoted and separated by tabs."""
    from ..functions.codec import quote_copy

    return rows.select(F.concat_ws("\t", *(quote_copy(F.col(c).cast("string")) for c in columns)).alias("value"))


def insert_text(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """INSERT statements (value)."""
    from ..functions.codec import quote_full_name, quote_ident, quote_literal

    names = F.concat_ws(", ", *(quote_ident(F.lit(c)) for c in columns))
    values = F.concat_ws(", ", *(quote_literal(F.col(c).cast("string")) for c in columns))
    return rows.select(F.concat(F.lit("insert into "), quote_full_name(F.lit(table)), F.lit(" ("), names, F.lit(") values ("), values, F.lit(");")).alias("value"))


def write_lines(lines: DataFrame, path: str, gzip: bool = False) -> None:
    """Lines (value) as text files, compressed or not, beside those that are there."""
    lines.select("value").write.mode("append").text(path, compression="gzip" if gzip else "none")


def read_copy(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines that :func:`copy_text` has made."""
    from ..functions.codec import unescape_copy

    parts = F.split("value", "\t")
    return spark.read.text(path).select(*(unescape_copy(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)))


def read_database(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A query's rows over JDBC, fetched a few at a time."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def maintained(rows: DataFrame, modify, path: str, count: str = "cnt") -> int:
    """Writes modify(rows), and returns how many rows it touched: the sum of its
    column count where it has one, else one a row."""
    from pyspark.sql import Observation

    out, seen = modify(rows), Observation()
    n = F.sum(F.coalesce(F.col(count).cast("long"), F.lit(1))) if count in out.columns else F.count("*")
    out.observe(seen, n.alias("n")).write.mode("append").parquet(path)
    return seen.get["n"] or 0


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=delimiter, quote=quote)


def read_tabs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header; rows of another width are dropped."""
    return spark.read.csv(path, schema=schema, header=True, sep="\t", mode="DROPMALFORMED")


def dump_json(events: DataFrame, path: str) -> None:
    """One JSON object per event, for people to look at what was lost."""
    events.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
