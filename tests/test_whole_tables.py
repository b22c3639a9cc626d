"""Queries that judge every tick and event, against plain Python."""

import random

import pyarrow.parquet as pq

from tidemark.model import TICK_SCHEMA
from tidemark.operators import batches as B
from tidemark.queries import QUERIES


def _events(data):
    return pq.read_table(f"{data}/events.parquet").to_pylist()


def test_visible_counts_across_buckets(spark):
    r = random.Random(5)
    txids = [r.randrange(3 * B.BUCKET) for _ in range(300)] + [B.BUCKET - 1, B.BUCKET, B.BUCKET] * 3
    made = [(0, 0, [])]
    for i, xmax in enumerate([1, 7, B.BUCKET - 1, B.BUCKET, B.BUCKET + 1, 2 * B.BUCKET, 9 * B.BUCKET], 1):
        xip = sorted({x for x in txids if x < xmax and r.random() < 0.1})
        made.append((i, xmax, xip))
    ticks = spark.createDataFrame([(1, i, None, (min([*xip, xmax]), xmax, xip), i) for i, xmax, xip in made], TICK_SCHEMA)
    events = spark.createDataFrame([(x,) for x in txids], "ev_txid long")
    got = {x.tick_id: x.n_visible for x in B.visible_counts(events, ticks).collect()}
    assert got == {i: sum(x < xmax and x not in xip for x in txids) for i, xmax, xip in made}


def test_every_tick_is_judged(spark, data):
    ticks = {(e["event_id"] + 1) // 100 for e in _events(data) if (e["event_id"] + 1) % 100 == 0} | {0}
    for name in ("snapshot_visibility_all", "serial_position_check_all"):
        assert sorted(x.tick_id for x in QUERIES[name](spark, data).collect()) == sorted(ticks), name


def test_every_event_is_base_or_change(spark, data):
    best = {}
    for e in sorted(_events(data), key=lambda e: e["event_id"]):
        best.setdefault(e["user_id"], ([], []))[e["event_id"] % 2].append(e)
    want = {}
    for user, (base, changes) in best.items():
        new = max(changes, key=lambda e: (e["ts"], -e["event_id"]), default=None)
        old = base[-1] if base else None
        want[user] = new["value"] if new and (not old or new["ts"] > max(e["ts"] for e in base)) else old["value"]
    assert {x.user_id: x.value for x in QUERIES["lww_conflict_all"](spark, data).collect()} == want


def test_every_event_is_a_member(spark, data):
    events = _events(data)
    now, want = max(e["ts"] for e in events), {}
    for e in events:
        if (now - e["ts"]).total_seconds() > 3600:
            key = (e["ts"], f"m{e['event_id']}", e["event_id"])
            want[f"g{e['event_id'] % 5}"] = min(want.get(f"g{e['event_id'] % 5}", key), key)
    assert {x.grp: (x.member, x.batch) for x in QUERIES["coop_takeover_all"](spark, data).collect()} == {g: k[1:] for g, k in want.items()}


def test_long_running_transactions_are_asked_for_by_id(spark):
    snap = "struct<xmin:bigint,xmax:bigint,xip:array<bigint>>"
    ticks = spark.createDataFrame(
        [(1, 1, None, 0, (3, 100000, [3, 7, 99998])), (1, 2, None, 5, (7, 100100, [7]))],
        f"tick_queue int, tick_id long, tick_time timestamp, tick_event_seq long, tick_snapshot {snap}",
    )
    tx = [3, 7, 50, 99997, 99998, 99999, 100050, 100100]
    events = spark.createDataFrame([(i, t, None) for i, t in enumerate(tx)], "ev_id long, ev_txid long, ev_owner int")
    second = B.batch_events(events, ticks, 2)
    assert [r.ev_txid for r in second.collect()] == [3, 99998, 100050]
    assert {r.ev_txid for r in B.batch_events(events, ticks, 1).collect()} == {50, 99997, 99999}
