"""All of the library's own queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec as C
from .model import format_snapshot, parse_snapshot, visible
from .operators import batches as B
from .operators import capture as K
from .operators import cascade as N
from .operators import compare as R
from .operators import fold as A
from .plans import seed as S

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "batch_summary"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seed(rest: str) -> str:
    return f"WITH {S.SQL.strip()} {rest}"


def _now(spark: SparkSession, d: str):
    """The log's last moment stands for now, read once."""
    return F.lit(S.table(spark, d, "events").agg(F.max("ts")).first()[0]).cast("timestamp")


def _log(spark, d) -> DataFrame:
    return B.assign_batches(S.evlog(spark, d), S.ticks(spark, d))


# ---- batches

@query(_seed("SELECT ev_id, ev_txid, batch_tick FROM batched"))
def batch_assignment(spark, d):
    return _log(spark, d).select("ev_id", "ev_txid", "batch_tick")


@query(_seed("SELECT batch_tick, count(*) AS n_events, min(ev_id) AS first_ev, max(ev_id) AS last_ev, count(*) FILTER (op = 'I') AS n_insert FROM batched GROUP BY 1"))
def batch_summary(spark, d):
    return _log(spark, d).groupBy("batch_tick").agg(F.count("*").alias("n_events"), F.min("ev_id").alias("first_ev"), F.max("ev_id").alias("last_ev"), F.count_if(F.startswith("ev_type", F.lit("I"))).alias("n_insert"))


@query(_seed("SELECT ev_id, ev_txid, op || ':user_id' AS ev_type FROM batched WHERE batch_tick = 5"))
def batch_events_one(spark, d):
    return B.batch_events(S.evlog(spark, d), S.ticks(spark, d), 5).select("ev_id", "ev_txid", "ev_type")


@query(_seed("SELECT ev_id, ev_txid FROM batched WHERE batch_tick = 7 AND op = 'U' ORDER BY ev_id LIMIT 20"))
def batch_cursor_limit_where(spark, d):
    return B.batch_events(S.evlog(spark, d), S.ticks(spark, d), 7, where="ev_type like 'U:%'", limit=20).select("ev_id", "ev_txid")


@query(_seed(f"SELECT t.tick_id, coalesce(sum(e.n), 0)::BIGINT AS n_visible FROM tk t LEFT JOIN (SELECT ev_txid, count(*) AS n FROM evlog GROUP BY 1) e ON e.ev_txid < t.xmax AND NOT (e.ev_txid % {S.STRIDE} = 0 AND e.ev_txid >= t.xmax - {S.LATE}) GROUP BY 1"))
def snapshot_visibility(spark, d):
    return B.visible_counts(S.evlog(spark, d), S.ticks(spark, d))


QUERIES["snapshot_visibility_all"], ORACLES["snapshot_visibility_all"] = snapshot_visibility, ORACLES["snapshot_visibility"]


@query(_seed(f"SELECT t.tick_id, t.xmax, coalesce(min(x.x), t.xmax) AS xmin, count(x.x) AS n_xip, t2.txt AS snap FROM tk t LEFT JOIN (SELECT tick_id, unnest(range(greatest(xmax - {S.LATE}, {S.FIRST_TX}), xmax)) AS x FROM tk) x ON x.tick_id = t.tick_id AND x.x % {S.STRIDE} = 0 JOIN (SELECT t.tick_id, coalesce(min(x), t.xmax)::VARCHAR || ':' || t.xmax || ':' || coalesce(string_agg(x::VARCHAR, ',' ORDER BY x), '') AS txt FROM tk t LEFT JOIN (SELECT tick_id, unnest(range(greatest(xmax - {S.LATE}, {S.FIRST_TX}), xmax)) AS x FROM tk) y ON y.tick_id = t.tick_id AND y.x % {S.STRIDE} = 0 GROUP BY t.tick_id, t.xmax) t2 ON t2.tick_id = t.tick_id GROUP BY t.tick_id, t.xmax, t2.txt"))
def snapshot_accessors(spark, d):
    t = S.ticks(spark, d).select("tick_id", format_snapshot(F.col("tick_snapshot")).alias("snap"))
    p = parse_snapshot(F.col("snap"))
    return t.select("tick_id", p["xmax"].alias("xmax"), p["xmin"].alias("xmin"), F.size(p["xip"]).cast("long").alias("n_xip"), "snap")


@query(_seed(f"SELECT a.tick_id, a.x AS txid FROM (SELECT tick_id, unnest(range(greatest(xmax - {S.LATE}, {S.FIRST_TX}), xmax)) AS x FROM tk) a JOIN tk b ON b.tick_id = a.tick_id + 1 WHERE a.x % {S.STRIDE} = 0 AND NOT (a.x >= b.xmax - {S.LATE} AND a.x < b.xmax)"))
def snapshot_diff_xip(spark, d):
    a = S.ticks(spark, d).select("tick_id", F.col("tick_snapshot.xip").alias("xa"))
    b = S.ticks(spark, d).select((F.col("tick_id") - 1).alias("tick_id"), F.col("tick_snapshot.xip").alias("xb"))
    return a.join(b, "tick_id").select("tick_id", F.explode(F.array_except("xa", "xb")).alias("txid"))


def _consumers(spark, d):
    t = S.ticks(spark, d).select("tick_queue", "tick_id")
    top = t.join(F.broadcast(t.groupBy("tick_queue").agg(F.max("tick_id").alias("top"))), "tick_queue")
    return top.where("tick_id % 9 = 0 and tick_id < top").select(F.concat(F.lit("c"), "tick_id").alias("consumer"), "tick_queue", F.col("tick_id").alias("last_tick"))


_NEXT = "cons AS (SELECT 'c' || tick_id AS consumer, tick_id AS last_tick, tick_time AS t0, tick_event_seq AS s0 FROM tk WHERE tick_id % 9 = 0 AND tick_id < (SELECT max(tick_id) FROM tk))"


def _picked(enough: str, far: str) -> str:
    return _seed(f""", {_NEXT},
    cand AS (SELECT c.consumer, c.last_tick, t.tick_id, ({enough}) AS enough, ({far}) AS far FROM cons c JOIN tk t ON t.tick_id > c.last_tick),
    g AS (SELECT consumer, last_tick, max(tick_id) AS newest, arg_max(enough, tick_id) AS e, arg_max(far, tick_id) AS f, min(tick_id) FILTER (enough) AS early FROM cand GROUP BY 1, 2)
    SELECT consumer, last_tick, CASE WHEN f THEN early WHEN e THEN newest END AS next_tick FROM g""")


@query(_seed(f", {_NEXT} SELECT consumer, last_tick, (SELECT min(tick_id) FROM tk t WHERE t.tick_id > c.last_tick) AS next_tick FROM cons c"))
def next_batch_simple(spark, d):
    return B.next_batch(S.ticks(spark, d), _consumers(spark, d)).select("consumer", "last_tick", "next_tick")


@query(_picked("t.tick_event_seq - c.s0 >= 450", "t.tick_event_seq - c.s0 > 900"))
def next_batch_min_count(spark, d):
    return B.next_batch(S.ticks(spark, d), _consumers(spark, d), min_count=450).select("consumer", "last_tick", "next_tick")


@query(_picked("epoch(t.tick_time) - epoch(c.t0) >= 36000", "epoch(t.tick_time) - epoch(c.t0) > 72000"))
def next_batch_min_interval(spark, d):
    return B.next_batch(S.ticks(spark, d), _consumers(spark, d), min_interval=36000).select("consumer", "last_tick", "next_tick")


@query(_seed(f", {_NEXT} SELECT consumer, last_tick, CASE WHEN epoch((SELECT max(ts) FROM events)) - epoch(n.tick_time) >= 86400 THEN n.tick_id END AS next_tick FROM cons c JOIN tk n ON n.tick_id = c.last_tick + 1"))
def next_batch_min_lag(spark, d):
    return B.next_batch(S.ticks(spark, d), _consumers(spark, d), now=_now(spark, d), min_lag=86400).select("consumer", "last_tick", "next_tick")


@query("SELECT (event_id + 1) // 500 AS tick_id, event_id + 1 AS tick_event_seq, ts AS tick_time FROM events WHERE (event_id + 1) % 500 = 0")
def ticker_count_policy(spark, d):
    return B.count_ticks(S.evlog(spark, d), 500)


@query()
def ticker_lag_policy(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("ts").alias("ev_time"))
    return B.ticker(e, "2024-01-01", period=60.0, max_count=50, max_lag=3600.0, idle=7200.0)


@query(_seed("SELECT t.tick_id - 1 AS prev_tick_id, t.tick_id, p.tick_time AS batch_start, t.tick_time AS batch_end, p.tick_event_seq AS seq_start, t.tick_event_seq AS seq_end, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(t.tick_time)) / 1e6 AS lag_sec FROM tk t JOIN tk p ON p.tick_id = t.tick_id - 1"))
def batch_info(spark, d):
    return B.batch_info(S.ticks(spark, d), _now(spark, d)).drop("tick_queue")


@query(_seed("""SELECT m AS last_tick_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(b.tick_time)) / 1e6 AS ticker_lag,
  round((b.tick_event_seq - a.tick_event_seq) / ((epoch_us(b.tick_time) - epoch_us(a.tick_time)) / 1e6), 6) AS ev_per_sec,
  (SELECT max(ev_id) FROM evlog) - b.tick_event_seq AS ev_new
  FROM (SELECT max(tick_id) AS m FROM tk) x JOIN tk b ON b.tick_id = m JOIN tk a ON a.tick_id = greatest(m - 20, 0)"""))
def queue_info(spark, d):
    seq = S.evlog(spark, d).agg(F.max("ev_id").alias("ev_seq")).withColumn("tick_queue", F.lit(1))
    return B.queue_info(S.ticks(spark, d), seq, _now(spark, d)).drop("tick_queue")


@query(_seed(f""", {_NEXT} SELECT consumer, last_tick, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(t0)) / 1e6 AS lag_sec,
  (SELECT max(tick_event_seq) FROM tk) - s0 AS pending_events FROM cons"""))
def consumer_info(spark, d):
    subs = _consumers(spark, d).select("*", F.lit(None).cast("long").alias("next_tick"), F.lit(None).cast("timestamp").alias("active"))
    return B.consumer_info(subs, S.ticks(spark, d), _now(spark, d)).select("consumer", "last_tick", "lag_sec", "pending_events")


def _queued(spark, d):
    return _log(spark, d).where("batch_tick = 4 and ev_id % 5 = 0").select("ev_id", F.lit(3).alias("ev_owner"), (F.col("ev_time") + F.make_dt_interval(secs=F.pmod("ev_id", F.lit(7)) * 10)).alias("ev_retry_after"))


@query(_seed("SELECT ev_id, ev_txid_null AS ev_txid, 1 AS ev_retry, 3 AS ev_owner FROM (SELECT *, NULL::BIGINT AS ev_txid_null FROM batched) WHERE batch_tick = 4 AND ev_id % 2 = 0 AND ev_id % 5 <> 0"))
def event_retry(spark, d):
    batch = _log(spark, d).where("batch_tick = 4").drop("batch_tick")
    return B.event_retry(batch, _queued(spark, d), F.col("ev_id") % 2 == 0, 3, _now(spark, d)).select("ev_id", "ev_txid", "ev_retry", "ev_owner")


@query(_seed("SELECT ev_id, 1 AS ev_retry FROM batched WHERE batch_tick = 4 AND ev_id % 5 <> 0"))
def batch_retry(spark, d):
    batch = _log(spark, d).where("batch_tick = 4").drop("batch_tick")
    return B.event_retry(batch.union(batch), _queued(spark, d), F.lit(True), 3, _now(spark, d)).select("ev_id", "ev_retry")


@query(_seed("SELECT ev_id, ev_time + to_seconds((ev_id % 7) * 10) AS ev_retry_after FROM batched WHERE batch_tick = 4 AND ev_id % 5 = 0 ORDER BY 2, 1 LIMIT 10"))
def retry_due_top10(spark, d):
    return B.due_retries(_queued(spark, d), _now(spark, d)).select("ev_id", "ev_retry_after")


_XMIN = f"(SELECT coalesce(min(x), t.xmax) FROM (SELECT unnest(range(greatest(t.xmax - {S.LATE}, {S.FIRST_TX}), t.xmax)) AS x) WHERE x % {S.STRIDE} = 0)"


def _queues(spark, d):
    """The queue as its third table is in use: switched at transaction 1500, some hours ago."""
    at = _now(spark, d) - F.make_dt_interval(hours=F.lit(3))
    return S.ticks(spark, d).select("tick_queue").distinct().select("tick_queue", F.lit(2).alias("cur_table"), F.lit(3).alias("n_tables"), at.alias("switch_time"), F.lit(1500).cast("long").alias("switch_step2"), F.lit(7200).alias("period_sec"))


@query(_seed(f"SELECT tick_id FROM tk t WHERE {_XMIN} < 1500"))
def rotation_gc(spark, d):
    return B.obsolete_ticks(S.ticks(spark, d), _queues(spark, d)).select("tick_id")


@query(_seed(f"SELECT v.low, {_XMIN} <= 1500 AS blocked, {_XMIN} > 1500 AS rotate, CASE WHEN {_XMIN} > 1500 THEN 0 ELSE 2 END AS cur_table FROM (VALUES (1), (8)) v(low) JOIN tk t ON t.tick_id = v.low * (SELECT max(tick_id) FROM tk) // 10"))
def rotation_step(spark, d):
    """The slowest consumer at a tenth and at eight tenths of the ticks."""
    t = S.ticks(spark, d)
    top = t.groupBy("tick_queue").agg(F.max("tick_id").alias("top"))
    out = None
    for low in (1, 8):
        subs = top.select("tick_queue", F.expr(f"{low} * top div 10").alias("last_tick"))
        got = B.rotation_due(_queues(spark, d), subs, t, _now(spark, d)).select(F.lit(low).alias("low"), "blocked", "rotate", "cur_table")
        out = got if out is None else out.union(got)
    return out


@query(_seed("SELECT tick_id, CASE WHEN xmax < 1200 THEN 'previous' WHEN lo > 1300 THEN 'current' ELSE 'previous,current' END AS tables FROM (SELECT t.tick_id, t.xmax, p.xmax AS lo FROM tk t JOIN tk p ON p.tick_id = t.tick_id - 1)"))
def pruned_tables(spark, d):
    t = S.ticks(spark, d).select("tick_id", F.col("tick_snapshot.xmax").alias("xmax"))
    p = t.select((F.col("tick_id") + 1).alias("tick_id"), F.col("xmax").alias("lo"))
    return t.join(p, "tick_id").select("tick_id", F.array_join(B.event_partitions(F.col("lo"), F.col("xmax"), F.lit(1200), F.lit(1300)), ",").alias("tables"))


@query(_seed("SELECT tick_id, (tick_id - 11) % 3 AS worker FROM tk WHERE tick_id > 10"))
def coop_assign(spark, d):
    return B.coop_batches(S.ticks(spark, d), 10, 3).select("tick_id", "worker")


@query("SELECT grp, arg_min(member, (active, member)) AS member, arg_min(batch, (active, member)) AS batch FROM (SELECT 'g' || (event_id % 5) AS grp, 'm' || event_id AS member, ts AS active, event_id AS batch FROM events) WHERE epoch((SELECT max(ts) FROM events)) - epoch(active) > 3600 GROUP BY 1")
def coop_takeover(spark, d):
    m = S.table(spark, d, "events").select(F.concat(F.lit("g"), F.col("event_id") % 5).alias("grp"), F.concat(F.lit("m"), "event_id").alias("member"), F.col("ts").alias("active"), F.col("event_id").alias("batch"))
    return B.coop_takeover(m, _now(spark, d), 3600)


QUERIES["coop_takeover_all"], ORACLES["coop_takeover_all"] = coop_takeover, ORACLES["coop_takeover"]


@query(_seed("SELECT 'c' || (tick_id % 4) AS consumer, tick_id AS batch_id FROM tk WHERE NOT (tick_id > 0 AND tick_id = (SELECT max(t.tick_id) FROM tk t WHERE t.tick_id % 4 = tk.tick_id % 4 AND t.tick_id < 60))"))
def exactly_once_dedupe(spark, d):
    b = S.ticks(spark, d).select(F.concat(F.lit("c"), F.col("tick_id") % 4).alias("consumer"), F.col("tick_id").alias("batch_id"))
    return B.not_done(b, b.where("batch_id < 60"))


@query(_seed("SELECT tick_id, CASE WHEN tick_id - 1 = 12 THEN 'process' WHEN tick_id = 12 THEN 'skip' ELSE 'lost' END AS step FROM tk"))
def serial_position_check(spark, d):
    return S.ticks(spark, d).select("tick_id", B.position(F.col("tick_id") - 1, F.col("tick_id"), F.lit(12)).alias("step"))


QUERIES["serial_position_check_all"], ORACLES["serial_position_check_all"] = serial_position_check, ORACLES["serial_position_check"]


@query(_seed("SELECT ev_id FROM evlog WHERE op = 'I'"))
def consumer_filter(spark, d):
    return S.evlog(spark, d).where(F.col("ev_extra1").isin("public.users") & A.op_of(F.col("ev_type")).isin("I")).select("ev_id")


@query(_seed("SELECT user_id::VARCHAR AS uid, event_type AS kind, count(*) AS n FROM evlog GROUP BY 1, 2"))
def field_map(spark, d):
    m = A.map_fields(C.url_map(F.col("ev_data")), {"user_id": "uid", "event_type": "kind", "value": "v", "none": "none"}, skip=("value",))
    return S.evlog(spark, d).select(m.alias("m")).select(F.col("m.uid").alias("uid"), F.col("m.kind").alias("kind")).groupBy("uid", "kind").agg(F.count("*").alias("n"))


# ---- folding and applying

def _changes(spark, d, where="true"):
    e = S.table(spark, d, "events").where(where)
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return e.select((F.col("event_id") + 1).alias("ev_id"), op.alias("op"), "user_id", "value", "ts")


_NET = """WITH c AS (SELECT event_id + 1 AS ev_id, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, user_id, value FROM events {where}),
 g AS (SELECT user_id, arg_min(op, ev_id) <> 'I' AS b, coalesce(arg_max(op, ev_id) FILTER (op <> 'U'), 'I') <> 'D' AS a, arg_max(value, ev_id) AS value, max(ev_id) AS ev_id FROM c GROUP BY 1),
 net AS (SELECT user_id, CASE WHEN b AND a THEN 'U' WHEN b THEN 'D' ELSE 'I' END AS op, ev_id, value FROM g WHERE b OR a)"""


@query(_NET.format(where="") + " SELECT user_id, op, ev_id, value FROM net")
def net_change(spark, d):
    return A.net_change(_changes(spark, d), ["user_id"], ["value"])


def _base(spark, d):
    return S.table(spark, d, "events").where("event_id < 400").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


_APPLY = _NET.format(where="WHERE event_id >= 400") + """,
 base AS (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id < 400 GROUP BY 1)
 SELECT coalesce(b.user_id, n.user_id) AS user_id, CASE WHEN n.op IN ('I', 'U') THEN n.value ELSE b.value END AS value
 FROM base b FULL JOIN net n ON n.user_id = b.user_id
 WHERE CASE WHEN n.op IS NULL THEN b.user_id IS NOT NULL WHEN n.op = 'D' THEN false WHEN n.op = 'U' THEN b.user_id IS NOT NULL ELSE true END"""


@query(_APPLY)
def table_after_changes(spark, d):
    net = A.net_change(_changes(spark, d, "event_id >= 400"), ["user_id"], ["value"])
    return A.apply_changes(_base(spark, d), net, ["user_id"], ["value"])


@query("SELECT CASE op WHEN 'U' THEN x ELSE op END AS op, count(*) AS n FROM (SELECT CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events) e, (VALUES ('D'), ('I')) v(x) WHERE op = 'U' OR op = x GROUP BY 1")
def keep_latest(spark, d):
    return A.row_mode(_changes(spark, d), "keep_latest").groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def keep_all(spark, d):
    return A.row_mode(_changes(spark, d), "keep_all").groupBy("user_id").agg(F.count("*").alias("n"))


def _dispatch(period, fmt):
    def run(spark, d):
        e = S.table(spark, d, "events")
        return e.groupBy(A.partition_name(F.lit("events"), F.col("ts"), period).alias("part")).agg(F.count("*").alias("n"))

    run.__name__ = f"dispatch_{period}"
    query(f"SELECT 'events_' || strftime(ts, '{fmt}') AS part, count(*) AS n FROM events GROUP BY 1")(run)


for _p, _f in (("hour", "%Y_%m_%d_%H"), ("day", "%Y_%m_%d"), ("month", "%Y_%m"), ("year", "%Y")):
    _dispatch(_p, _f)


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS lower, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS upper FROM orders")
def partition_bounds(spark, d):
    b = A.partition_bounds(F.col("o_orderdate"), "month")
    return S.table(spark, d, "orders").select(b["lower"].cast("timestamp").alias("lower"), b["upper"].cast("timestamp").alias("upper")).distinct()


@query("SELECT part, part < 'events_2024_01_15' AS old FROM (SELECT DISTINCT 'events_' || strftime(ts, '%Y_%m_%d') AS part FROM events)")
def retention_obsolete(spark, d):
    parts = S.table(spark, d, "events").select(A.partition_name(F.lit("events"), F.col("ts"), "day").alias("part")).distinct()
    return parts.select("part", A.obsolete(F.col("part"), "events", "day", F.lit("2024-01-15").cast("timestamp")).alias("old"))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id % 4 = 2 GROUP BY 1")
def shard_filter(spark, d):
    return S.table(spark, d, "events").where(A.in_shard(F.col("user_id"), 3, 2)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT user_id, arg_max(value, event_id) AS value, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY 1),
 c AS (SELECT user_id, arg_max(value, (ts, -event_id)) AS value, max(ts) AS ts FROM events WHERE event_id % 2 = 1 GROUP BY 1)
 SELECT coalesce(b.user_id, c.user_id) AS user_id, CASE WHEN c.user_id IS NOT NULL AND (b.user_id IS NULL OR c.ts > b.ts) THEN c.value ELSE b.value END AS value FROM b FULL JOIN c ON b.user_id = c.user_id""")
def lww_conflict(spark, d):
    e = S.table(spark, d, "events")
    base = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("ts"))
    changes = e.where("event_id % 2 = 1").select("user_id", "value", "ts", F.col("event_id").alias("ev_id"))
    return A.newest_wins(changes, base, ["user_id"], "ts", ["value"]).select("user_id", "value")


QUERIES["lww_conflict_all"], ORACLES["lww_conflict_all"] = lww_conflict, ORACLES["lww_conflict"]


@query("WITH e AS (SELECT event_id AS ev_id, 't' || (user_id % 5) AS t, event_id % 701 = 700 AS r FROM events), c AS (SELECT t, max(ev_id) AS m FROM e WHERE r GROUP BY 1) SELECT e.t AS ev_extra1, count(*) AS n FROM e LEFT JOIN c ON c.t = e.t WHERE NOT r AND (m IS NULL OR ev_id > m) GROUP BY 1")
def truncate_cutoff(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("ev_id"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("ev_extra1"), F.when(F.expr("event_id % 701 = 700"), "R").otherwise("U:id").alias("ev_type"))
    return A.after_truncate(e).groupBy("ev_extra1").agg(F.count("*").alias("n"))


@query(_seed(f"SELECT count(*) AS n, min(ev_id) AS first_ev FROM evlog WHERE NOT (ev_txid < 1333 AND NOT (ev_txid % {S.STRIDE} = 0 AND ev_txid >= 1293))"))
def copy_snapshot_filter(spark, d):
    snap = S.ticks(spark, d).where("tick_id = 10").select("tick_snapshot")
    return S.evlog(spark, d).join(snap, ~visible(F.col("ev_txid"), F.col("tick_snapshot"))).agg(F.count("*").alias("n"), F.min("ev_id").alias("first_ev"))


# ---- capture

_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _versions(spark, d):
    """Two versions of orders: every 10th updated, 17th deleted, 23rd new."""
    o = S.table(spark, d, "orders").select(*_COLS)
    old = o.where("o_orderkey % 23 <> 0")
    new = o.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, F.concat("o_orderstatus", F.lit("'\\%"))).otherwise(F.col("o_orderstatus")))
    return old, new


_VERSIONS = r"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders),
 old AS (SELECT * FROM o WHERE k % 23 <> 0),
 new AS (SELECT k, c, CASE WHEN k % 10 = 0 THEN s || '''\%' ELSE s END AS s, p FROM o WHERE k % 17 <> 0),
 d AS (SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'I' WHEN n.k IS NULL THEN 'D' WHEN n.s <> o.s THEN 'U' END AS op,
   o.c AS oc, o.s AS os, o.p AS op_, n.c AS nc, n.s AS ns, n.p AS np FROM old o FULL JOIN new n ON n.k = o.k)"""
_ENC = r"replace(replace(replace(replace({}, '%', '%25'), '''', '%27'), '\', '%5c'), ' ', '+')"
_LIT = r"CASE WHEN contains({0}, '\') THEN 'E''' || replace(replace({0}, '''', ''''''), '\', '\\') || '''' ELSE '''' || replace({0}, '''', '''''') || '''' END"


def _row_sql(c, s, p):
    return f"'o_orderkey=' || k || '&o_custkey=' || {c} || '&o_orderstatus=' || {_ENC.format(s)} || '&o_orderpriority=' || {_ENC.format(p)}"


@query(_VERSIONS + f" SELECT k AS o_orderkey, op || ':o_orderkey' AS ev_type, CASE WHEN op = 'D' THEN {_row_sql('oc', 'os', 'op_')} ELSE {_row_sql('nc', 'ns', 'np')} END AS ev_data FROM d WHERE op IS NOT NULL")
def capture_urlencoded(spark, d):
    return K.url_events(K.diff(*_versions(spark, d), ["o_orderkey"]), ["o_orderkey"], _COLS)


@query(_VERSIONS + f" SELECT k AS o_orderkey, op || ':o_orderkey' AS ev_type, CASE WHEN op <> 'I' THEN {_row_sql('oc', 'os', 'op_')} END AS ev_extra2 FROM d WHERE op IS NOT NULL")
def capture_backup(spark, d):
    return K.url_events(K.diff(*_versions(spark, d), ["o_orderkey"]), ["o_orderkey"], _COLS, backup=True).drop("ev_data")


@query(_VERSIONS + f""" SELECT k AS o_orderkey, op AS ev_type, CASE op WHEN 'I' THEN '(o_orderkey,o_custkey,o_orderstatus,o_orderpriority) values (''' || k || ''',''' || nc || ''',' || {_LIT.format('ns')} || ',' || {_LIT.format('np')} || ')'
  WHEN 'U' THEN 'o_orderstatus=' || {_LIT.format('ns')} || ' where o_orderkey=''' || k || '''' ELSE 'o_orderkey=''' || k || '''' END AS ev_data FROM d WHERE op IS NOT NULL""")
def capture_partial_sql(spark, d):
    return K.sql_events(K.diff(*_versions(spark, d), ["o_orderkey"]), ["o_orderkey"], _COLS)


@query(_VERSIONS + " SELECT op, count(*) AS n FROM d WHERE op IN ('I', 'D') GROUP BY 1")
def capture_ignore(spark, d):
    return K.diff(*_versions(spark, d), ["o_orderkey"], ignore=("o_orderstatus",)).groupBy("op").agg(F.count("*").alias("n"))


@query(_VERSIONS + " SELECT op, count(*) AS n FROM d WHERE op IS NOT NULL AND CASE WHEN op = 'D' THEN oc ELSE nc END % 2 = 0 GROUP BY 1")
def capture_when(spark, d):
    return K.diff(*_versions(spark, d), ["o_orderkey"], when="o_custkey % 2 = 0").groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_orderstatus || '''\\%' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0")
def capture_apply_round_trip(spark, d):
    old, new = _versions(spark, d)
    ev = K.url_events(K.diff(old, new, ["o_orderkey"]), ["o_orderkey"], _COLS)
    m = C.url_map(F.col("ev_data"))
    net = ev.select("o_orderkey", A.op_of(F.col("ev_type")).alias("op"), *(m[c].cast(t).alias(c) for c, t in new.dtypes if c != "o_orderkey"))
    return A.apply_changes(old, net, ["o_orderkey"], _COLS[1:])


# ---- compare and repair

@query(_VERSIONS + " SELECT (SELECT count(*) FROM old) AS n_old, (SELECT count(*) FROM new) AS n_new")
def compare_count(spark, d):
    old, new = _versions(spark, d)
    return R.checksum(old, _COLS).select(F.col("cnt").alias("n_old")).crossJoin(R.checksum(new, _COLS).select(F.col("cnt").alias("n_new")))


@query(r"SELECT count(*) AS cnt, sum(('0x' || substr(md5(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority), 1, 15))::BIGINT::HUGEINT)::DECIMAL(38,0) AS chk FROM orders")
def compare_checksum_md5(spark, d):
    return R.md5_checksum(S.table(spark, d, "orders"), _COLS)


@query(_VERSIONS + " SELECT k AS o_orderkey, CASE op WHEN 'I' THEN 'insert' WHEN 'D' THEN 'delete' ELSE 'update' END AS op, CASE WHEN op = 'U' THEN 'o_orderstatus' WHEN op = 'I' OR op = 'D' THEN 'o_custkey,o_orderstatus,o_orderpriority' END AS changed FROM d WHERE op IS NOT NULL")
def repair_diff(spark, d):
    old, new = _versions(spark, d)
    return R.differences(new, old, ["o_orderkey"], _COLS).select("o_orderkey", "op", F.array_join("changed", ",").alias("changed"))


@query(_VERSIONS + f" SELECT k AS o_orderkey, 'update only public.orders set o_orderstatus = ' || {_LIT.format('ns')} || ' where o_orderkey = ''' || k || ''' and o_orderstatus = ' || {_LIT.format('os')} || ';' AS sql FROM d WHERE op = 'U'")
def repair_update_sql(spark, d):
    old, new = _versions(spark, d)
    return R.repair_sql(new, old, "public.orders", ["o_orderkey"], _COLS).where("op = 'update'").select("o_orderkey", "sql")


# ---- nodes

def _nodes(spark, d):
    """Nations as nodes: number n copies from (n - 1) div 3."""
    k = F.col("n_nationkey")
    return S.table(spark, d, "nation").select(k.alias("node"), F.when(k > 0, F.expr("(n_nationkey - 1) div 3")).alias("provider"), F.when(k == 0, "root").when(k < 8, "branch").otherwise("leaf").alias("node_type"), (100 - k).alias("completed_tick"))


_NODES = """WITH RECURSIVE nodes AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS provider, CASE WHEN n_nationkey = 0 THEN 'root' WHEN n_nationkey < 8 THEN 'branch' ELSE 'leaf' END AS node_type, 100 - n_nationkey AS completed_tick FROM nation),
 clo AS (SELECT node, node AS below, 0 AS depth FROM nodes UNION ALL SELECT c.node, n.node, c.depth + 1 FROM clo c JOIN nodes n ON n.provider = c.below),
 cons AS (SELECT s_nationkey AS node, 'c' || s_suppkey AS consumer, 50 + s_suppkey % 40 AS last_tick FROM supplier),
 low AS (SELECT node, min(last_tick) AS low FROM cons WHERE node % 3 > 0 GROUP BY 1),
 lw AS (SELECT n.node, CASE WHEN node_type = 'leaf' THEN completed_tick ELSE coalesce(low, 99) END AS w FROM nodes n LEFT JOIN low l ON l.node = n.node)"""


def _local(spark, d):
    nodes = _nodes(spark, d)
    cons = S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("node"), F.when(F.col("s_nationkey") % 3 > 0, F.concat(F.lit("c"), "s_suppkey")).otherwise(".global_watermark").alias("consumer"), (50 + F.col("s_suppkey") % 40).alias("last_tick"))
    return N.local_watermark(nodes, cons, nodes.select("node", F.lit(99).alias("tick_id")))


@query(_NODES + " SELECT node, w AS local_watermark FROM lw")
def local_watermark(spark, d):
    return _local(spark, d)


@query(_NODES + " SELECT c.node, min(w) AS watermark FROM clo c JOIN lw ON lw.node = c.below GROUP BY 1")
def global_watermark(spark, d):
    return N.global_watermark(_nodes(spark, d), _local(spark, d))


@query(_NODES + " SELECT node, count(*) - 1 AS total_childs, max(depth) + 1 AS levels FROM clo GROUP BY 1")
def tree_stats(spark, d):
    return N.tree_stats(_nodes(spark, d))


@query(_NODES + " SELECT below AS node FROM clo WHERE node = 1 AND depth > 0")
def node_depends(spark, d):
    return N.closure(_nodes(spark, d)).where("node = 1 and depth > 0").select(F.col("below").alias("node"))


_STATES = "CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'in-copy' WHEN 2 THEN 'catching-up' WHEN 3 THEN 'wanna-sync:9' WHEN 4 THEN 'do-sync:9' ELSE 'ok' END"


def _tables(spark, d):
    return S.table(spark, d, "nation").select(F.col("n_name").alias("table_name"), "n_nationkey", "n_regionkey", F.expr(_STATES).alias("merge_state"), F.lit(None).cast("string").alias("custom_snapshot"))


@query(f"SELECT count(*) FILTER (s IS NULL) AS missing, count(*) FILTER (s = 'in-copy') AS copying, count(*) FILTER (s = 'catching-up') AS catching_up, count(*) FILTER (s LIKE 'wanna%') AS wanna_sync, count(*) FILTER (s LIKE 'do%') AS do_sync, count(*) FILTER (s = 'ok') AS ok FROM (SELECT {_STATES} AS s FROM nation)")
def table_state_counts(spark, d):
    return N.state_counts(_tables(spark, d))


# Roles of three parts that fill one table, by their states (! marks a part that has dropped the DDL).
COPY_ROLES = """
!catching-up catching-up catching-up NULL wait-replay wait-replay
!catching-up catching-up in-copy wait-replay wait-replay wait-replay
!catching-up in-copy catching-up wait-replay wait-replay wait-replay
!catching-up in-copy in-copy wait-replay wait-replay wait-replay
!in-copy catching-up catching-up lead wait-replay wait-replay
!in-copy catching-up in-copy lead wait-replay wait-replay
!in-copy in-copy catching-up lead wait-replay wait-replay
!in-copy in-copy in-copy lead wait-replay wait-replay
catching-up !catching-up catching-up wait-replay NULL wait-replay
catching-up !catching-up in-copy wait-replay wait-replay wait-replay
catching-up !in-copy catching-up wait-replay lead wait-replay
catching-up !in-copy in-copy wait-replay lead wait-replay
catching-up catching-up !catching-up wait-replay wait-replay NULL
catching-up catching-up !in-copy wait-replay wait-replay lead
catching-up catching-up catching-up NULL NULL NULL
catching-up catching-up in-copy NULL NULL wait-replay
catching-up in-copy !catching-up wait-replay wait-replay wait-replay
catching-up in-copy !in-copy wait-replay wait-replay lead
catching-up in-copy catching-up NULL wait-replay NULL
catching-up in-copy in-copy NULL wait-replay wait-replay
in-copy !catching-up catching-up wait-replay wait-replay wait-replay
in-copy !catching-up in-copy wait-replay wait-replay wait-replay
in-copy !in-copy catching-up wait-replay lead wait-replay
in-copy !in-copy in-copy wait-replay lead wait-replay
in-copy catching-up !catching-up wait-replay wait-replay wait-replay
in-copy catching-up !in-copy wait-replay wait-replay lead
in-copy catching-up catching-up wait-replay NULL NULL
in-copy catching-up in-copy wait-replay NULL wait-replay
in-copy in-copy !catching-up wait-replay wait-replay wait-replay
in-copy in-copy !in-copy wait-replay wait-replay lead
in-copy in-copy catching-up wait-replay wait-replay NULL
in-copy in-copy in-copy lead wait-copy wait-copy
""".split()
_COPIES = [(n // 6, n % 6 + 1, COPY_ROLES[n], COPY_ROLES[n + 3]) for n in range(len(COPY_ROLES)) if n % 6 < 3]


@query("SELECT * FROM (VALUES " + ", ".join(f"('t{t:02}', 'part{p}', {'NULL' if r == 'NULL' else repr(r)})" for t, p, _, r in _COPIES) + ") v(table_name, queue, copy_role)")
def copy_coordination(spark, d):
    rows = [(f"part{p}", f"t{t:02}", s.lstrip("!"), "x" if s[0] == "!" else None, True, "all") for t, p, s, _ in _COPIES]
    rows += [(f"part{p}", f"t{t:02}", "ok", None, True, "other") for t, p, _, _ in _COPIES]  # of another combined queue: no part in it
    parts = spark.createDataFrame(rows, "queue string, table_name string, state string, dropped_ddl string, local boolean, combined string")
    return N.copy_roles(parts).where("state <> 'ok'").select("table_name", "queue", "copy_role")


@query(f"WITH ok AS (SELECT n_name FROM nation WHERE {_STATES} = 'ok'), p AS (SELECT a.n_name AS from_table, b.n_name AS to_table FROM nation a JOIN nation b ON b.n_nationkey % 6 = 5) SELECT from_table, to_table FROM p WHERE from_table IN (SELECT n_name FROM ok) AND to_table IN (SELECT n_name FROM ok)")
def fkeys_ready(spark, d):
    t = _tables(spark, d)
    pending = t.select(F.col("table_name").alias("from_table")).join(t.where("n_nationkey % 6 = 5").select(F.col("table_name").alias("to_table")), F.lit(True))
    return N.ready_keys(pending, t).select("from_table", "to_table")


@query("SELECT 'table' AS kind, n_name AS name FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'seq', r_name FROM region")
def missing_tables(spark, d):
    n, r = S.table(spark, d, "nation"), S.table(spark, d, "region")
    have = n.select(F.lit("table").alias("kind"), F.col("n_name").alias("name")).union(r.select(F.lit("seq"), "r_name"))
    return N.missing(have, n.where("n_nationkey % 4 = 1").select(F.lit("table").alias("kind"), F.col("n_name").alias("name")))


@query(_seed(f"SELECT ev_id FROM evlog e WHERE (ev_txid < 1200 AND NOT (ev_txid % {S.STRIDE} = 0 AND ev_txid >= 1160)) AND NOT (ev_txid < 1100 AND NOT (ev_txid % {S.STRIDE} = 0 AND ev_txid >= 1060))"))
def resurrect_lost(spark, d):
    t = S.ticks(spark, d).where("tick_id in (3, 6)").groupBy().agg(F.max_by("tick_snapshot", "tick_id").alias("cur"), F.min_by("tick_snapshot", "tick_id").alias("last"))
    return S.evlog(spark, d).join(t, visible(F.col("ev_txid"), F.col("cur")) & ~visible(F.col("ev_txid"), F.col("last"))).select("ev_id")


@query(_seed("SELECT 'public.users' AS ev_extra1, count(*) FILTER (op = 'I') AS inserts, count(*) FILTER (op = 'U') AS updates, count(*) FILTER (op = 'D') AS deletes, bool_and(op <> 'U') AS can_rollback FROM batched WHERE batch_tick > 5"))
def resurrect_stats(spark, d):
    return N.lost_stats(_log(spark, d).where("batch_tick > 5"))


# ---- functions

@query("SELECT page_id, url AS decoded FROM pages")
def urlencode_round_trip(spark, d):
    p = S.table(spark, d, "pages").select("page_id", C.url_row({"u": F.col("url"), "e": F.lit(""), "n": F.lit(None).cast("string")}).alias("r"))
    return p.select("page_id", C.url_map(F.col("r"))["u"].alias("decoded"))


@query(r"SELECT doc_id, CASE WHEN contains(text, '\') THEN 'E''' || replace(replace(text, '''', ''''''), '\', '\\') || '''' ELSE '''' || replace(text, '''', '''''') || '''' END AS lit FROM documents")
def quote_literal(spark, d):
    return S.table(spark, d, "documents").select("doc_id", C.quote_literal(F.col("text")).alias("lit"))


_IDENTS = {"fetch": '"fetch"', "over": '"over"', "lateral": '"lateral"', "collation": '"collation"', "plain_1": "plain_1", "1st": '"1st"', "": '""', "a b": '"a b"', 'q"q': '"q""q"', "Baz": '"Baz"', "select": '"select"', "selected": "selected"}


@query("SELECT r_regionkey, '\"' || r_name || '\"' AS ident, 'public.' || '\"' || r_name || '\"' AS full_name FROM region UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(-1, '{v}', 'public.{v}')" for v in _IDENTS.values()) + ") v")
def quote_ident(spark, d):
    names = S.table(spark, d, "region").select("r_regionkey", "r_name").union(spark.createDataFrame([(-1, k) for k in _IDENTS], "r_regionkey int, r_name string"))
    return names.select("r_regionkey", C.quote_ident(F.col("r_name")).alias("ident"), C.quote_full_name(F.col("r_name")).alias("full_name"))


@query("SELECT p_partkey, '{' || p_size || ',NULL,\"' || p_brand || '\",\"\",a-b,\"a:b\",' || lower(replace(p_brand, '#', '')) || '}' AS arr FROM part")
def pgarray(spark, d):
    items = [F.col("p_size").cast("string"), F.lit(None).cast("string"), F.col("p_brand"), F.lit(""), F.lit("a-b"), F.lit("a:b"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))]
    return S.table(spark, d, "part").select("p_partkey", C.pg_array(F.array(*items)).alias("arr"))


@query("SELECT p_partkey, p_brand || '\"\\,' AS a, p_name AS b, 4 AS n FROM part")
def pgarray_round_trip(spark, d):
    items = F.array(F.concat("p_brand", F.lit('"\\,')), "p_name", F.lit(None).cast("string"), F.lit(""))
    back = C.parse_pg_array(F.concat(F.lit("[0,3]="), C.pg_array(items)))
    return S.table(spark, d, "part").select("p_partkey", back.alias("x")).where("x[2] is null and x[3] = ''").select("p_partkey", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.size("x").alias("n"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def natsort(spark, d):
    long = F.concat(F.lit("007"), F.repeat(F.lit("9"), F.lit(24)))  # digits beyond any number type
    named = S.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("cust-"), long, F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".x")).alias("name"))
    w = Window.orderBy(C.natural_key(F.col("name")))  # a total order is the feature: one task sorts a small table
    return named.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS at FROM orders")
def iso_ts(spark, d):
    o = S.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss,SSS")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.lit("+00")))
    return o.select("o_orderkey", C.iso_timestamp(text).alias("at"))


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY 1")
def pivot_metrics(spark, d):
    return R.pivot_last(S.table(spark, d, "events"), ["user_id"], "event_type", "value", "event_id", ["click", "view"])


@query("SELECT 'k' || (event_id % 3) AS key, sum(event_id)::DOUBLE AS total FROM events GROUP BY 1 UNION ALL SELECT 'f', sum(event_id % 7 + 0.5)::DOUBLE FROM events")
def stats_aggregate(spark, d):
    line = F.concat(F.lit("{k"), F.col("event_id") % 3, F.lit(": "), "event_id", F.lit(", f: "), (F.col("event_id") % 7).cast("string"), F.lit(".5}"))
    return R.stat_sums(S.table(spark, d, "events").select(line.alias("line")), "line").select("key", F.col("total").cast("double").alias("total"))


@query()
def hashtext(spark, d):
    from .functions.hashes import hashtext_new, hashtext_old

    return S.table(spark, d, "customer").select("c_custkey", hashtext_old(F.col("c_name")).alias("old"), hashtext_new(F.col("c_name")).alias("new"))


from . import state_queries  # noqa: E402, F401  (adds its queries)
