"""What only larger tables show: rows that end up deleted, names that are cut, ticks by the thousand."""

import random

from pyspark.sql import functions as F

from tidemark.functions import codec as C
from tidemark.operators import batches as B
from tidemark.operators import conflict as M
from tidemark.queries import ORACLES, QUERIES


def test_a_key_may_end_up_without_a_row(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "k long, stamp string, v double")
    changes = spark.createDataFrame([(1, "D", 1, "b", None), (2, "U", 2, "b", 3.0), (3, "D", 3, "c", 4.0)], "ev_id long, op string, k long, stamp string, v double")
    assert [tuple(r) for r in M.merge_on_time(base, changes, ["k"], "stamp", ["v"]).collect()] == [(2, "b", 3.0)]


def _plain_next(ticks, places, count=None, seconds=None):
    """Every later tick looked at."""
    out = {}
    for q, p in places:
        here = {i: (s, n) for k, i, s, n in ticks if k == q}
        later = sorted(i for i in here if i > p)
        if p not in here or not later:
            out[q, p] = None
            continue
        over = lambda i, x: (count is not None and (here[i][1] - here[p][1] >= count if x == 1 else here[i][1] - here[p][1] > x * count)) or (seconds is not None and (here[i][0] - here[p][0] >= seconds if x == 1 else here[i][0] - here[p][0] > x * seconds))  # noqa: E731, B023
        if count is None and seconds is None:
            out[q, p] = later[0]
        else:
            out[q, p] = next(i for i in later if over(i, 1)) if over(later[-1], 2) else later[-1] if over(later[-1], 1) else None
    return out


def test_next_batch_equals_a_plain_search(spark):
    """Times and counts that also fall, gaps in the ids, places where no tick is, two queues with one consumer."""
    r = random.Random(3)
    ids = sorted({*range(700), *r.sample(range(200_000), 800)})
    ticks = [(q, i, r.randrange(50) + i // 40 * (q == 1), r.randrange(100) + i // 300) for q in (1, 2) for i in ids if q == 1 or i % 3]
    t = spark.createDataFrame(ticks, "tick_queue int, tick_id long, s long, tick_event_seq long").withColumn("tick_time", F.timestamp_seconds("s"))
    places = [(q, p) for q in (1, 2) for p in [*r.sample(ids, 60), ids[-1], 0, 5, 5]]
    last = spark.createDataFrame([("c", q, p) for q, p in places], "consumer string, tick_queue int, last_tick long")
    for count, seconds in ((None, None), (60, None), (None, 30), (200, 900)):
        got = B.next_batch(t, last, min_count=count, min_interval=seconds)
        assert got.columns == ["consumer", "tick_queue", "last_tick", "next_tick"]
        rows = got.collect()
        want = _plain_next(ticks, places, count, seconds)
        assert len(rows) == len(places) and {(x.tick_queue, x.last_tick): x.next_tick for x in rows} == want


def test_a_place_meets_few_ticks(spark):
    """Rows made by joins: a few hundred a place, whatever the number of ticks."""
    t = spark.range(4000).select(F.lit(1).alias("tick_queue"), F.col("id").alias("tick_id"), F.timestamp_seconds("id").alias("tick_time"), F.col("id").alias("tick_event_seq"))
    last = t.where("tick_id < 3999").select(F.col("tick_id").cast("string").alias("consumer"), "tick_queue", F.col("tick_id").alias("last_tick"))
    df = B.next_batch(t, last, min_count=2000)
    assert df.count() == 3999
    plan = df._jdf.queryExecution()
    df.write.format("noop").mode("overwrite").save()
    plan.executedPlan().execute().count()
    todo, most = [plan.executedPlan()], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.finalPhysicalPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 3999 * B.FAN


def test_members_whose_names_are_cut_equal_sql(spark, tmp_path):
    import duckdb

    ids = "SELECT event_id FROM range(2000) t(event_id) UNION ALL SELECT event_id FROM range(1000100, 1000199) t(event_id) UNION ALL SELECT event_id FROM range(100010, 100030) t(event_id)"
    rows = f"SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id * 37 % 5003 * 600) AS ts, event_id % 40 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM ({ids})"
    con = duckdb.connect()
    con.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["coop_next_batch"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['coop_next_batch']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_a_row_is_decoded_once(spark):
    """Not once more for each of its fields: the text is split in one place of the plan."""
    df = spark.createDataFrame([("a=1&b=%c3%bc+x&c&a=2=%zz&d=",)], "c string").select(C.url_map(F.col("c")).alias("m"))
    assert df.first()["m"] == {"b": "ü x", "c": None, "a": "2=%zz", "d": ""}
    assert df._jdf.queryExecution().analyzed().toString().count("split(c#") == 1


def test_url_codecs_of_plain_and_odd_texts(spark):
    texts = ["", "plain_1.x-y", "a\n", "~*", "ü+%", "a b", "%41%4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, c string")
    got = rows.select("c", C.url_encode(F.col("c")).alias("e"), C.url_decode(C.url_encode(F.col("c"))).alias("d"), C.url_decode(F.col("c")).alias("p"), C.url_row({"a b": F.col("c"), "k": F.col("c")}).alias("r")).orderBy("i").collect()
    assert [x.e for x in got] == ["", "plain_1.x-y", "a%0a", "%7e%2a", "%c3%bc%2b%25", "a+b", "%2541%254"]
    assert [x.d for x in got] == texts
    assert [x.p for x in got] == ["", "plain_1.x-y", "a\n", "~*", "ü %", "a b", "A%4"]
    assert [x.r for x in got] == [f"a+b={x.e}&k={x.e}" for x in got]
