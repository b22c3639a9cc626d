"""The queue's core: which events a batch has, which batch comes next, what a
queue and its consumers lag, retries, rotation, cooperation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import visible

#: Transactions per bucket of the range join between events and ticks.
BUCKET = 4096
#: Ticks, or groups of them, per group in the search for a later tick; how often they are grouped.
FAN, LEVELS = 256, 2


def _previous(ticks: DataFrame) -> DataFrame:
    w = Window.partitionBy("tick_queue").orderBy("tick_id")
    return ticks.select("*", F.lag("tick_id").over(w).alias("prev_id"), F.lag("tick_time").over(w).alias("prev_time"), F.lag("tick_event_seq").over(w).alias("prev_seq"), F.lag("tick_snapshot").over(w).alias("prev_snapshot"), F.lead("tick_id").over(w).alias("next_id"))


def assign_batches(events: DataFrame, ticks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """events of one queue with batch_tick: the first tick whose snapshot shows
    the event, null while none does.

    Visibility never ends, so per transaction there is one such tick: for one
    that some tick holds as running, the tick after the last that does; for
    the others, the tick whose [previous xmax, xmax) it falls into. Both sides
    are small next to the log and joined to it on equal keys (the range by
    buckets of transactions); the log is shuffled only if they aren't.
    """
    t = _previous(ticks)
    lo, hi = F.coalesce(F.col("prev_snapshot.xmax"), F.lit(0)), F.col("tick_snapshot.xmax")
    ranges = t.where(hi > lo).select(F.col("tick_id").alias("range_tick"), lo.alias("lo"), hi.alias("hi"))
    # Below the first xmax anything is visible in the first tick, however old: one open bucket.
    first = F.col("lo") == 0
    spans = ranges.select("*", F.explode(F.when(first, F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.expr(f"lo div {bucket}"), F.expr(f"(hi - 1) div {bucket}")))).alias("b"))
    start = ranges.where(first).agg(F.max("hi").alias("h"))
    held = t.select("tick_id", "next_id", F.explode("tick_snapshot.xip").alias("txid")).groupBy("txid").agg(F.max_by("next_id", "tick_id").alias("held_tick"))
    e = events.crossJoin(F.broadcast(start))  # one row
    b = F.when(F.col("ev_txid") < F.coalesce("h", F.lit(0)), F.lit(-1).cast("bigint")).otherwise(F.expr(f"ev_txid div {bucket}"))
    inside = (F.col("b") == F.col("sb")) & (F.col("ev_txid") >= F.col("lo")) & (F.col("ev_txid") < F.col("hi"))
    joined = e.withColumn("b", b).join(spans.withColumnRenamed("b", "sb"), inside, "left")
    full = joined.join(held, F.col("ev_txid") == F.col("txid"), "left")
    return full.select(*events.columns, F.when(F.col("txid").isNotNull(), F.col("held_tick")).otherwise(F.col("range_tick")).alias("batch_tick"))


def visible_counts(events: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per tick (tick_id, n_visible): the events that its snapshot shows.

    Those of transactions below its xmax, less those it holds as running. The
    former are summed per bucket of transactions, and by rank only within the
    bucket that xmax falls into, so no tick meets the whole log; the running
    totals are over buckets, one row each.
    """
    by_tx = events.groupBy("ev_txid").agg(F.count("*").alias("n")).withColumn("b", F.expr(f"ev_txid div {BUCKET}"))
    t = ticks.select("tick_id", F.col("tick_snapshot.xmax").alias("xmax"), F.col("tick_snapshot.xip").alias("xip")).withColumn("b", F.expr(f"xmax div {BUCKET}"))
    needed = by_tx.groupBy("b").agg(F.sum("n").alias("n")).unionByName(t.select("b").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("b").agg(F.sum("n").alias("n"))
    whole = needed.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("below"))
    part = t.join(by_tx, "b").where("ev_txid < xmax").groupBy("tick_id").agg(F.sum("n").alias("inside"))
    held = t.select("tick_id", "xmax", F.explode(F.array_distinct("xip")).alias("ev_txid")).where("ev_txid < xmax").join(by_tx.select("ev_txid", "n"), "ev_txid").groupBy("tick_id").agg(F.sum("n").alias("held"))
    none = lambda c: F.coalesce(c, F.lit(0))
    full = t.select("tick_id", "b").join(whole, "b").join(part, "tick_id", "left").join(held, "tick_id", "left")
    return full.select("tick_id", (F.col("below") + none(F.col("inside")) - none(F.col("held"))).alias("n_visible"))


def between(events: DataFrame, last: Column, cur: Column, lo: int | None = None, hi: int | None = None, owner: int | None = None, also: tuple[int, ...] = ()) -> DataFrame:
    """Events visible in cur and not in last, of no owner or the given one.
    lo and hi (inclusive) bound their transactions, also names some below lo; as
    plain predicates they reach the file scan, which snapshots do not."""
    out = events
    if lo is not None:
        from_lo = F.col("ev_txid") >= lo
        out = out.where(from_lo | F.col("ev_txid").isin(*also) if also else from_lo)
    if hi is not None:
        out = out.where(F.col("ev_txid") <= hi)
    mine = F.col("ev_owner").isNull() | (F.col("ev_owner") == F.lit(owner)) if owner is not None else F.col("ev_owner").isNull()
    return out.where(visible(F.col("ev_txid"), cur) & ~F.coalesce(visible(F.col("ev_txid"), last), F.lit(False)) & mine)


def batch_events(events: DataFrame, ticks: DataFrame, tick_id: int, where: str | None = None, limit: int | None = None) -> DataFrame:
    """The events of the batch that ends at tick_id, in order of ev_id; where is
    a SQL predicate over them, limit the first rows only (a cursor's fetch). A
    transaction that ran for long is asked for by its id, so that it doesn't
    widen the range that is read."""
    row = _previous(ticks).where(F.col("tick_id") == tick_id).select("tick_snapshot", "prev_snapshot").first()
    if row is None:
        raise ValueError(f"no tick {tick_id}")
    snap = lambda s: F.struct(F.lit(s.xmin).cast("bigint").alias("xmin"), F.lit(s.xmax).cast("bigint").alias("xmax"), F.array(*map(F.lit, s.xip)).cast("array<bigint>").alias("xip"))
    cur, last = row["tick_snapshot"], row["prev_snapshot"]
    near = [x for x in last.xip if x >= last.xmax - BUCKET] if last else []
    far = tuple(x for x in last.xip if x < last.xmax - BUCKET) if last else ()
    lo = min([last.xmax, *near]) if last else None
    nothing = F.struct(F.lit(0).cast("bigint").alias("xmin"), F.lit(0).cast("bigint").alias("xmax"), F.array().cast("array<bigint>").alias("xip"))
    out = between(events, snap(last) if last else nothing, snap(cur), lo, cur.xmax - 1, also=far)
    out = (out.where(F.expr(where)) if where else out).orderBy("ev_id")
    return out.limit(limit) if limit is not None else out


def event_partitions(tx_min: Column, tx_max: Column, step1: Column, step2: Column) -> Column:
    """Which rotation tables a batch may have events in: previous, current or both."""
    return F.when(tx_max < step1, F.array(F.lit("previous"))).when(tx_min > step2, F.array(F.lit("current"))).otherwise(F.array(F.lit("previous"), F.lit("current")))


def next_batch(ticks: DataFrame, last: DataFrame, now: Column | None = None, min_lag: float | None = None, min_count: int | None = None, min_interval: float | None = None) -> DataFrame:
    """Per consumer row (consumer, tick_queue, last_tick): next_tick, null if none.

    Without min_count and min_interval: the first tick after last_tick. With
    them the newest tick is looked at first: does the batch up to it have
    min_count events or span min_interval seconds? If by over twice either
    bound, the earliest tick that satisfies one of them is taken instead.
    min_lag: a tick younger than that many seconds at ``now`` gives none.
    """
    # What comes next is the queue's and the tick's, not the consumer's: asked once per tick stood at.
    t = ticks.select("tick_queue", "tick_id", F.unix_micros("tick_time").alias("us"), F.col("tick_event_seq").alias("seq"))
    base = t.toDF("tick_queue", "last_tick", "last_us", "last_seq")
    at = last.select("tick_queue", "last_tick").distinct().join(base, ["tick_queue", "last_tick"])
    # Both rise with what they compare, so a group of ticks has one that is enough if its largest values are.
    seconds = lambda us: us / 1e6 - F.col("last_us") / 1e6
    events = lambda seq: seq - F.col("last_seq")
    if min_count is not None or min_interval is not None:

        def over(us: Column, seq: Column, times: int) -> Column:
            out = F.lit(False)
            if min_count is not None:
                out = out | (events(seq) >= min_count if times == 1 else events(seq) > times * min_count)
            if min_interval is not None:
                out = out | (seconds(us) >= min_interval if times == 1 else seconds(us) > times * min_interval)
            return F.coalesce(out, F.lit(False))

        newest = t.groupBy("tick_queue").agg(F.max_by(F.struct("tick_id", "us", "seq"), "tick_id").alias("n"))
        top = at.join(F.broadcast(newest), "tick_queue").where("n.tick_id > last_tick")
        far, enough = over(F.col("n.us"), F.col("n.seq"), 2), over(F.col("n.us"), F.col("n.seq"), 1)
        at = top.select(*at.columns, far.alias("seek"), F.when(enough & ~far, F.col("n.tick_id")).alias("whole"))
        found = _first_later(t, at, lambda us, seq: over(us, seq, 1)).select("tick_queue", "last_tick", F.coalesce("found", "whole").alias("next_tick"))
    else:
        found = _first_later(t, at.withColumn("seek", F.lit(True)), lambda us, seq: F.lit(True)).select("tick_queue", "last_tick", F.col("found").alias("next_tick"))
    if min_lag is not None:
        age = (F.unix_micros(now) - F.col("us")) / 1e6
        found = found.join(t.withColumnRenamed("tick_id", "next_tick"), ["tick_queue", "next_tick"]).where(age >= min_lag)
    found = found.groupBy("tick_queue", "last_tick").agg(F.min("next_tick").alias("next_tick"))
    return last.join(found, ["tick_queue", "last_tick"], "left").select(*last.columns, "next_tick")


def _first_later(t: DataFrame, at: DataFrame, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """at (tick_queue, last_tick, seek, …) with found: the first tick of t
    (tick_queue, tick_id, us, seq) after last_tick that fits, where seek holds.

    fits must hold for a group's largest us and seq if and only if it does for
    one of its ticks. Ticks are grouped by FAN, those groups by FAN again, and
    so on for LEVELS; the search climbs until a later group fits and descends
    into it, so each row meets FAN others at most per step, and all groups of
    the last level, one per FAN ** LEVELS ids of a queue.
    """
    group = lambda c, k: F.expr(f"{c} div {FAN ** k}")
    rows = at.withColumns({"found": F.lit(None).cast("long"), "level": F.lit(None).cast("int")})

    def step(rows: DataFrame, k: int, down: bool) -> DataFrame:
        nodes = t.groupBy(F.col("tick_queue").alias("__q"), group("tick_id", k).alias("__id")).agg(F.max("us").alias("__us"), F.max("seq").alias("__seq"))
        nodes = nodes.withColumn("__up", group("__id", 1)) if k < LEVELS else F.broadcast(nodes)
        open_ = (F.col("level") == k + 1) if down else F.col("seek") & F.col("found").isNull() & (F.col("__id") > group("last_tick", k))
        same = F.col("tick_queue") == F.col("__q")
        if k < LEVELS:
            up = group("last_tick", k + 1)
            same = same & (F.col("__up") == (F.when(F.col("level") == k + 1, F.col("found")).otherwise(up) if down else up))
        pairs = rows.join(nodes, same & open_ & fits(F.col("__us"), F.col("__seq")), "left")
        got = pairs.groupBy(*rows.columns).agg(F.min("__id").alias("__got"))
        new = F.col("__got").isNotNull()
        changed = {"found": F.when(new, F.col("__got")).otherwise(F.col("found")), "level": F.when(new, F.lit(k)).otherwise(F.col("level"))}
        return got.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns))

    for k in range(LEVELS + 1):
        rows = step(rows, k, False)
    for k in reversed(range(LEVELS)):
        rows = step(rows, k, True)
    return rows.drop("level")


def count_ticks(events: DataFrame, max_count: int) -> DataFrame:
    """Ticks of the count rule alone: one at every max_count-th event."""
    return events.where(F.col("ev_id") % max_count == 0).select((F.col("ev_id") / max_count).cast("long").alias("tick_id"), F.col("ev_id").alias("tick_event_seq"), F.col("ev_time").alias("tick_time"))


def decide_tick(new_events: int, lag: float, last_gap: float | None, max_count: int = 500, max_lag: float = 3.0, idle: float = 60.0) -> bool:
    """Would the ticker tick now? lag: seconds since the last tick; last_gap:
    seconds between the last two, None without a previous tick."""
    if new_events > 0:
        return new_events >= max_count or lag >= max_lag
    if last_gap is None:
        return True
    return not (lag < max_lag / 2 or (lag < 2 * last_gap and lag < idle))


def ticker(events: DataFrame, start: str, period: float = 1.0, max_count: int = 500, max_lag: float = 3.0, idle: float = 60.0) -> DataFrame:
    """Ticks that a ticker waking every period seconds would cut per queue.

    A sequential rule: events are first counted per queue and wake-up (a
    distributed aggregate), and only those counts are folded, queue by queue.
    """
    at = F.floor((F.unix_micros("ev_time") - F.unix_micros(F.lit(start).cast("timestamp"))) / (period * 1e6)).cast("long") + 1
    counts = events.groupBy("queue", at.alias("wake")).agg(F.count("*").alias("n"))

    def fold(pdf):
        import pandas as pd

        rows, seq, ticked, gap, last = [], 0, 0, None, 0
        pdf = pdf.sort_values("wake")
        for wake, n in zip(pdf["wake"].tolist(), pdf["n"].tolist(), strict=True):
            # Wake-ups without events since the last one may tick, too.
            for w in range(last + 1, wake + 1):
                if w == wake:
                    seq += n
                lag = (w - ticked) * period
                if decide_tick(seq - (rows[-1][2] if rows else 0), lag, gap, max_count, max_lag, idle):
                    gap = lag
                    ticked = w
                    rows.append((len(rows) + 1, w, seq))
            last = wake
        out = pd.DataFrame(rows, columns=["tick_id", "wake", "tick_event_seq"]).astype("int64")
        out.insert(0, "queue", pdf["queue"].iloc[0])
        return out

    return counts.groupBy("queue").applyInPandas(fold, "queue string, tick_id long, wake long, tick_event_seq long")


def batch_info(ticks: DataFrame, now: Column) -> DataFrame:
    """Per batch (tick with one before it): its ticks, times, sequence range and lag in seconds."""
    t = _previous(ticks).where("prev_id is not null")
    return t.select("tick_queue", F.col("prev_id").alias("prev_tick_id"), F.col("tick_id"), F.col("prev_time").alias("batch_start"), F.col("tick_time").alias("batch_end"), F.col("prev_seq").alias("seq_start"), F.col("tick_event_seq").alias("seq_end"), ((F.unix_micros(now) - F.unix_micros("tick_time")) / 1e6).alias("lag_sec"))


def queue_info(ticks: DataFrame, newest_seq: DataFrame, now: Column, last: int = 20) -> DataFrame:
    """Per queue: ticker lag, events per second over its last ticks (null where
    no time passed), events not yet ticked, last tick. newest_seq: (tick_queue, ev_seq)."""
    top = ticks.groupBy("tick_queue").agg(F.max("tick_id").alias("last_tick_id"))
    recent = ticks.join(top, "tick_queue").where(F.col("tick_id") >= F.col("last_tick_id") - last)
    g = recent.groupBy("tick_queue", "last_tick_id").agg(F.max_by(F.struct("tick_time", "tick_event_seq"), "tick_id").alias("b"), F.min_by(F.struct("tick_time", "tick_event_seq"), "tick_id").alias("a"))
    took = (F.unix_micros("b.tick_time") - F.unix_micros("a.tick_time")) / 1e6
    rate = F.when(took > 0, F.round((F.col("b.tick_event_seq") - F.col("a.tick_event_seq")) / took, 6))
    return g.join(newest_seq, "tick_queue").select("tick_queue", "last_tick_id", ((F.unix_micros(now) - F.unix_micros("b.tick_time")) / 1e6).alias("ticker_lag"), rate.alias("ev_per_sec"), (F.col("ev_seq") - F.col("b.tick_event_seq")).alias("ev_new"))


def consumer_info(subs: DataFrame, ticks: DataFrame, now: Column) -> DataFrame:
    """Per subscription (consumer, tick_queue, last_tick, next_tick, active): lag,
    seconds since it was seen, pending events up to the newest tick."""
    t = ticks.select("tick_queue", F.col("tick_id").alias("last_tick"), "tick_time", "tick_event_seq")
    newest = ticks.groupBy("tick_queue").agg(F.max_by("tick_event_seq", "tick_id").alias("top_seq"))
    s = lambda c: (F.unix_micros(now) - F.unix_micros(c)) / 1e6
    return subs.join(t, ["tick_queue", "last_tick"], "left").join(newest, "tick_queue", "left").select("consumer", "tick_queue", "last_tick", "next_tick", s("tick_time").alias("lag_sec"), s("active").alias("last_seen_sec"), (F.col("top_seq") - F.col("tick_event_seq")).alias("pending_events"))


def event_retry(batch: DataFrame, queued: DataFrame, wanted: Column, owner: int, after: Column) -> DataFrame:
    """New rows of the retry queue: the wanted events of a batch that owner
    hasn't queued yet, once each, their retry count raised, without transaction."""
    rows = batch.where(wanted).dropDuplicates(["ev_id"])
    old = queued.where(F.col("ev_owner") == owner).select("ev_id")
    out = rows.join(old, "ev_id", "left_anti")
    changed = {"ev_retry": F.coalesce("ev_retry", F.lit(0)) + 1, "ev_txid": F.lit(None).cast("long"), "ev_owner": F.lit(owner)}
    return out.withColumns(changed).withColumn("ev_retry_after", after)


def due_retries(queued: DataFrame, now: Column, most: int = 10) -> DataFrame:
    """The rows due first, most of them at once (a step of a loop that runs
    until none is due); they go back with their id and owner."""
    return queued.where(F.col("ev_retry_after") <= now).orderBy("ev_retry_after", "ev_id").limit(most)


def obsolete_ticks(ticks: DataFrame, queues: DataFrame) -> DataFrame:
    """Ticks that a rotation deletes: those whose snapshot's xmin is below the
    transaction of the rotation before (queues: tick_queue, switch_step2)."""
    return ticks.join(queues.select("tick_queue", "switch_step2"), "tick_queue").where(F.col("tick_snapshot.xmin") < F.col("switch_step2")).select(*ticks.columns)


def rotation_due(queues: DataFrame, subs: DataFrame, ticks: DataFrame, now: Column) -> DataFrame:
    """Per queue (tick_queue, cur_table, n_tables, switch_time, switch_step2,
    period_sec): due, blocked (the slowest consumer's tick may still need the
    table that would be emptied), whether to rotate, and the table in use after
    it. A consumer whose tick is gone is an error."""
    low = subs.groupBy("tick_queue").agg(F.min("last_tick").alias("last_tick"))
    seen = low.join(ticks.select("tick_queue", F.col("tick_id").alias("last_tick"), F.col("tick_snapshot.xmin").alias("xmin")), ["tick_queue", "last_tick"], "left")
    j = queues.join(seen, "tick_queue", "left")
    xmin = F.when(F.col("last_tick").isNotNull() & F.col("xmin").isNull(), F.raise_error("a consumer's tick is not there").cast("bigint")).otherwise(F.col("xmin"))
    due = ((F.unix_micros(now) - F.unix_micros("switch_time")) / 1e6 > F.col("period_sec")) & F.col("switch_step2").isNotNull()
    blocked = F.coalesce(xmin <= F.col("switch_step2"), F.lit(False))
    rows = j.select("tick_queue", "cur_table", "n_tables", F.coalesce(due, F.lit(False)).alias("due"), blocked.alias("blocked"))
    go = F.col("due") & ~F.col("blocked")
    return rows.select("tick_queue", "due", "blocked", go.alias("rotate"), F.when(go, (F.col("cur_table") + 1) % F.col("n_tables")).otherwise(F.col("cur_table")).alias("cur_table"))


def coop_batches(ticks: DataFrame, last_tick: int, workers: int) -> DataFrame:
    """Open batches after last_tick dealt in turn to a consumer's workers."""
    w = Window.partitionBy("tick_queue").orderBy("tick_id")
    return ticks.where(F.col("tick_id") > last_tick).select("tick_queue", "tick_id", ((F.row_number().over(w) - 1) % workers).alias("worker"))


def coop_takeover(members: DataFrame, now: Column, dead_sec: float) -> DataFrame:
    """Per group the open batch to take over: of the member idle for over
    dead_sec for longest (then by name); members: (grp, member, active, batch)."""
    dead = members.where(F.col("batch").isNotNull() & ((F.unix_micros(now) - F.unix_micros("active")) / 1e6 > dead_sec))
    return dead.groupBy("grp").agg(F.min_by(F.struct("member", "batch"), F.struct("active", "member")).alias("m")).select("grp", F.col("m.member").alias("member"), F.col("m.batch").alias("batch"))


def not_done(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows (consumer, batch_id, …) that the ledger doesn't name as the consumer's
    latest done batch; an id of 0 or less is never recorded, so never skipped."""
    latest = ledger.where("batch_id > 0").groupBy("consumer").agg(F.max("batch_id").alias("done"))
    return batches.join(latest, "consumer", "left").where("batch_id <= 0 or done is null or batch_id <> done").drop("done")


def position(prev_tick: Column, cur_tick: Column, done_tick: Column) -> Column:
    """What a serial consumer does with a batch: process, skip, or lost."""
    return F.when(done_tick.isNull() | (prev_tick == done_tick), "process").when(cur_tick == done_tick, "skip").otherwise("lost")


def forwarded(events: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    """Data events only, for a queue that merges several: control events stay behind."""
    out = events
    for prefix in drop:
        out = out.where(~F.startswith("ev_type", F.lit(prefix)))
    return out
