import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec as C
from tidemark.functions import hashes as H
from tidemark.functions import sqltext as Q
from tidemark.model import parse_snapshot, visible
from tidemark.operators import batches as B
from tidemark.operators import fold as A


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_hash_values():
    v = [b"x" * i for i in range(5)]
    assert H.lookup3(v).tolist() == [-1477818771, 1074944137, -1086392228, -1992236649, -1379736791]
    assert H.lookup2(v).tolist() == [-863449762, 37835117, 294739542, -320432768, 1007638138]


def test_visibility(spark):
    rows = spark.range(11, 22).select("id", visible(F.col("id"), parse_snapshot(F.lit("12:20:13,15,18"))).alias("v")).collect()
    assert "".join("t" if r.v else "f" for r in rows) == "ttftfttftff"


def test_bad_snapshots_are_errors(spark):
    for text in ("31:12:", "0:1:", "12:13:0", "12:16:14,13", "1:2"):
        with pytest.raises(Exception, match="bad snapshot"):
            one(spark, text, parse_snapshot)


def test_codecs(spark):
    assert one(spark, "foo=1&bar&baz=&foo=%262", C.url_map) == {"bar": None, "baz": "", "foo": "&2"}
    assert one(spark, "a b*ü/", C.url_encode) == "a+b%2a%c3%bc%2f"
    assert one(spark, "it's \\", C.quote_literal) == "E'it''s \\\\'"
    assert one(spark, None, C.quote_literal) == "null" and one(spark, None, C.quote_copy) == "\\N"
    assert one(spark, "a\tb\\", C.quote_copy) == "a\\tb\\\\"
    assert one(spark, "select", C.quote_ident) == '"select"' and one(spark, "good_1", C.quote_ident) == "good_1"
    assert one(spark, "a.b.c", C.quote_full_name) == 'a."b.c"' and one(spark, "t", C.full_name) == "public.t"
    assert one(spark, "2.5MB", C.size_bytes) == 2621440 and one(spark, "x", C.size_bytes) is None
    names = spark.createDataFrame([("a10",), ("a9",), ("A1",)], "c string")
    assert [r.c for r in names.orderBy(C.natural_key(F.col("c"), fold=True)).collect()] == ["A1", "a9", "a10"]


def test_sql_text():
    assert Q.statements("a; b ';' (c;d);\n-- x;\ne") == ["a;", "b ';' (c;d);", "-- x;\ne"]
    assert Q.partial_sql("I", "(a,\"b c\") values ('x''y',null)") == {"a": "x'y", "b c": None}
    assert Q.partial_sql("U", "a=E'1\\n' where k='2'") == {"a": "1\n", "k": "2"}
    assert Q.build_query([("select * from t where a = {a}", True), ("and b = {b}", False)], {"a": 1}) == ("select * from t where a = :a", {"a": 1})


def test_net_change_equals_replay(spark):
    import itertools

    rows, want = [], {}
    for n, h in enumerate(h for k in range(1, 6) for h in itertools.product("IUD", repeat=k)):
        state, first = None, h[0] != "I"
        alive = True
        for i, op in enumerate(h):
            rows.append((n, i, op, f"{n}.{i}"))
            alive = op != "D" if op in "ID" else alive
            state = f"{n}.{i}"
        want[n] = {(True, True): "U", (True, False): "D", (False, True): "I"}.get((first, alive)), state
    got = {r.k: (r.op, r.v) for r in A.net_change(spark.createDataFrame(rows, "k int, ev_id int, op string, v string"), ["k"], ["v"]).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_ticker_rule():
    assert B.decide_tick(500, 0, 1) and B.decide_tick(1, 3, 1) and not B.decide_tick(1, 2.9, 1)
    assert B.decide_tick(0, 1, None) and not B.decide_tick(0, 1, 1) and not B.decide_tick(0, 10, 6) and B.decide_tick(0, 12, 6) and B.decide_tick(0, 61, 59)


def test_streaming_replay_equals_batch(spark, data, tmp_path):
    from tidemark.queries import _changes
    from tidemark.sources.state import State
    from tidemark.streaming.replay import exactly_once, replayer

    changes = _changes(spark, data).select("ev_id", "op", "user_id", "value")
    changes.repartitionByRange(4, "ev_id").sortWithinPartitions("ev_id").write.parquet(str(tmp_path / "log"))
    schema = "user_id long, value double"
    table, ledger = State(spark, str(tmp_path / "t"), schema), State(spark, str(tmp_path / "l"), "consumer string, last_tick long")
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "log"))
    run = exactly_once(replayer(table, ["user_id"], ["value"]), ledger, "c")
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = A.apply_changes(spark.createDataFrame([], schema), A.net_change(changes, ["user_id"], ["value"]), ["user_id"], ["value"])
    assert sorted(map(tuple, table.load().collect())) == sorted(map(tuple, want.collect()))
    before = table._versions()
    run(changes, 0)
    assert table._versions() == before
