"""Consumers of a queue from registration to retry: state tables in, state
tables out. A state table is a DataFrame; save it with sources.state.

Subscriptions: sub_id, tick_queue, consumer, last_tick, next_tick, batch,
active. A cooperative member has no last_tick of its own. Ids that a database
takes from a sequence are hashes of what they name, so that a repeated step
gives the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import due_retries, event_retry, next_batch

SUBSCRIPTION = "sub_id long, tick_queue int, consumer string, last_tick long, next_tick long, batch long, active timestamp"
_COLUMNS = [x.split()[0] for x in SUBSCRIPTION.split(", ")]


def _error(when: Column, text: str, kind: str = "bigint") -> Column:
    return F.when(when, F.raise_error(text).cast(kind))


def register(subs: DataFrame, ticks: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """subs after registrations wanted (tick_queue, consumer, at), with ``new``:
    1 for new ones, 0 for those that were there, null for the rest.

    A new consumer starts at tick ``at``, or at the queue's newest. One that is
    there moves only if ``at`` is given, which drops its open batch. A tick
    that doesn't exist, or a queue without ticks, is an error.
    """
    newest = ticks.groupBy("tick_queue").agg(F.max("tick_id").alias("top"))
    known = ticks.select("tick_queue", F.col("tick_id").alias("at"), F.lit(True).alias("known"))
    w = wanted.join(newest, "tick_queue", "left").join(known, ["tick_queue", "at"], "left")
    place = F.coalesce(_error(F.col("at").isNotNull() & F.col("known").isNull(), "cannot reposition, no such tick"), _error(F.col("top").isNull(), "the queue has no ticks"), F.col("at"), F.col("top"))
    w = w.select("tick_queue", "consumer", place.alias("place"), F.col("at").isNotNull().alias("moves"), F.lit(True).alias("asked"))
    j = subs.join(w, ["tick_queue", "consumer"], "full")
    there, asked = F.col("sub_id").isNotNull(), F.coalesce("asked", F.lit(False))
    reset = asked & (F.col("moves") | ~there)
    keep = lambda c: F.when(~reset, F.col(c)).alias(c)
    return j.select(
        F.coalesce("sub_id", F.xxhash64("tick_queue", "consumer")).alias("sub_id"), "tick_queue", "consumer",
        F.when(reset, F.col("place")).otherwise(F.col("last_tick")).alias("last_tick"), keep("next_tick"), keep("batch"),
        F.when(reset & there, now).otherwise(F.col("active")).alias("active"), F.when(asked, F.when(there, 0).otherwise(1)).alias("new"),
    )


def unregister(subs: DataFrame, retries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subs, retry queue, removed (tick_queue, consumer, n)) without the
    consumers gone (tick_queue, consumer). A member of a cooperative group goes
    alone; its main consumer takes the whole group and its retries along."""
    member = F.col("last_tick").isNull() == F.col("next_tick").isNull()
    sizes = subs.groupBy("sub_id").agg(F.count("*").alias("size"))
    hit = subs.join(gone.select("tick_queue", "consumer"), ["tick_queue", "consumer"]).join(sizes, "sub_id").select("sub_id", "tick_queue", "consumer", (member & (F.col("size") > 1)).alias("alone"), "size")
    whole = hit.where("not alone").select("sub_id").distinct()
    left = subs.join(whole, "sub_id", "left_anti").join(hit.where("alone").select("sub_id", "consumer"), ["sub_id", "consumer"], "left_anti").select(*subs.columns)
    kept = retries.join(whole.withColumnRenamed("sub_id", "ev_owner"), "ev_owner", "left_anti").select(*retries.columns)
    return left, kept, hit.select("tick_queue", "consumer", F.when(F.col("alone"), 1).otherwise(F.col("size")).alias("n"))


def open_batches(subs: DataFrame, ticks: DataFrame, now: Column, **custom) -> DataFrame:
    """subs where each consumer without an open batch has its next one opened,
    if there is any (see :func:`batches.next_batch` for custom); an open batch
    stays as it is. A consumer whose tick is gone is an error."""
    idle = subs.where("batch is null and last_tick is not null")
    have = ticks.select("tick_queue", F.col("tick_id").alias("last_tick"), F.lit(True).alias("there"))
    checked = idle.join(have, ["tick_queue", "last_tick"], "left").select("tick_queue", F.coalesce(_error(F.col("there").isNull(), "a consumer's tick is not there"), "last_tick").alias("last_tick"), F.col("sub_id").cast("string").alias("consumer"))
    found = next_batch(ticks, checked, now=now, **custom).where("next_tick is not null").select(F.col("consumer").cast("long").alias("sub_id"), F.col("next_tick").alias("found"))
    j = subs.join(found, "sub_id", "left")
    opens = F.col("found").isNotNull() & F.col("batch").isNull() & F.col("last_tick").isNotNull()
    new = {"next_tick": F.col("found"), "batch": F.abs(F.xxhash64("sub_id", "found")), "active": now}
    return j.select(*(F.when(opens, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in subs.columns))


def finish_batches(subs: DataFrame, batches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(subs, done (batch, found)): consumers of the batches stand at their
    batch's end; found is 0 for a batch that nobody has open."""
    b = batches.select("batch").distinct()
    hit = subs.join(b.withColumn("__done", F.lit(True)), "batch", "left")
    done = F.coalesce("__done", F.lit(False))
    null = F.lit(None).cast("long")
    new = {"last_tick": F.col("next_tick"), "next_tick": null, "batch": null, "active": now}
    out = hit.select(*(F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in subs.columns))
    open_ = subs.where("batch is not null").select("batch", F.lit(1).alias("found")).distinct()
    return out, b.join(open_, "batch", "left").select("batch", F.coalesce("found", F.lit(0)).alias("found"))


def tagged(batch: DataFrame, tags: DataFrame, queued: DataFrame, owner: int, now: Column, default: str | None = "done") -> DataFrame:
    """Rows for the retry queue of a batch whose events a consumer has tagged:
    tags (ev_id, tag, seconds), tag done or retry. An event without a tag is
    done, or an error if there is no default."""
    t = tags.select("ev_id", F.col("tag").alias("__tag"), F.col("seconds").alias("__sec"))
    rest = F.lit(default) if default is not None else F.raise_error("untagged event").cast("string")
    j = batch.join(t, "ev_id", "left").withColumn("__tag", F.coalesce("__tag", rest))
    wanted = F.when(F.col("__tag").isin("done", "retry"), F.col("__tag") == "retry").otherwise(F.raise_error("unknown tag").cast("boolean"))
    after = now + F.make_dt_interval(secs=F.coalesce("__sec", F.lit(60)).cast("decimal(18,6)"))
    return event_retry(j, queued, wanted, owner, after).drop("__tag", "__sec")


def reinsert(log: DataFrame, queued: DataFrame, now: Column, txid: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, retry queue) after due events have gone back, with their id, owner
    and retry count, in a new transaction: all due ones, or the first most of
    them (a step of the loop that repeats while any is due)."""
    due = queued.where(F.col("ev_retry_after") <= now) if most is None else due_retries(queued, now, most)
    back = due.select(*(F.lit(txid).cast("long").alias(c) if c == "ev_txid" else F.col(c) for c in log.columns))
    return log.unionByName(back), queued.join(due.select("ev_owner", "ev_id"), ["ev_owner", "ev_id"], "left_anti").select(*queued.columns)


# ---- queues and ticks

#: Settings of a queue that may be changed.
SETTINGS = ("queue_ticker_max_count", "queue_ticker_max_lag", "queue_ticker_idle_period", "queue_ticker_paused", "queue_rotation_period", "queue_external_ticker")


def set_config(queues: DataFrame, queue: str, name: str, value) -> DataFrame:
    """queues with one setting changed; only those of SETTINGS may be."""
    key = name if name.startswith("queue_") else f"queue_{name}"
    if key not in SETTINGS:
        raise ValueError(f"no such setting: {name}")
    return queues.withColumn(key, F.when(F.col("queue_name") == queue, F.lit(value).cast(queues.schema[key].dataType)).otherwise(F.col(key)))


def create_queue(queues: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queues, (queue_name, created)): 1 for new ones, 0 for those that exist."""
    new = names.select("queue_name").distinct().join(queues.select("queue_name", F.lit(0).alias("__old")), "queue_name", "left")
    return queues.unionByName(new.where("__old is null").select("queue_name"), allowMissingColumns=True), new.select("queue_name", F.coalesce("__old", F.lit(1)).alias("created"))


def drop_queue(queues: DataFrame, consumers: DataFrame, gone: DataFrame, force: bool = False) -> DataFrame:
    """queues without those gone (queue_name); one with consumers (queue_name, consumer) is an error unless forced."""
    used = consumers.select("queue_name").distinct().withColumn("__used", F.lit(True))
    g = gone.select("queue_name").distinct().join(used, "queue_name", "left")
    bad = F.lit(not force) & F.col("__used").isNotNull()
    g = g.where(F.when(bad, F.raise_error("the queue has consumers").cast("boolean")).otherwise(True)).drop("__used")
    return queues.join(g, "queue_name", "left_anti")


def setval(current: Column, wanted: Column) -> Column:
    """A sequence's value after it is set: never backwards."""
    return F.greatest(current, wanted)


def force_tick(seq: Column, max_count: Column) -> Column:
    """The event sequence moved on so far that the next ticker must tick."""
    return seq + 2 * max_count + 1000


def external_ticks(queues: DataFrame, ticks: DataFrame, given: DataFrame) -> DataFrame:
    """ticks and those given (tick_queue, tick_id, tick_time, tick_event_seq),
    which only an external, unpaused queue takes."""
    j = given.join(queues.select("tick_queue", "external", "paused"), "tick_queue", "left")
    fine = F.coalesce(F.col("external") & ~F.col("paused"), F.lit(False))
    checked = j.where(F.when(fine, True).otherwise(F.raise_error("queue is not external, or paused").cast("boolean")))
    return ticks.unionByName(checked.select(*given.columns), allowMissingColumns=True)


def ticks_due(queues: DataFrame) -> DataFrame:
    """Which of all queues tick now, in order of name. queues: queue_name,
    external, paused, new_events, lag and last_gap in seconds, max_count,
    max_lag, idle. Idle queues back off: each pause is twice the one before."""
    busy = (F.col("new_events") >= F.col("max_count")) | (F.col("lag") >= F.col("max_lag"))
    quiet = (F.col("lag") < F.col("max_lag") / 2) | ((F.col("lag") < 2 * F.col("last_gap")) & (F.col("lag") < F.col("idle")))
    tick = F.when(F.col("new_events") > 0, busy).when(F.col("last_gap").isNull(), True).otherwise(~quiet)
    return queues.where(~F.col("external") & ~F.col("paused")).where(tick).select("queue_name").orderBy("queue_name")


def maintenance(queues: DataFrame, tables: DataFrame) -> DataFrame:
    """Work items (func, arg): rotation per queue, its second step once, each
    queue's extra functions, retries, and tables to vacuum. queues: queue_name,
    due, extra (array of names)."""
    rotate = queues.where("due").select(F.lit("rotate").alias("func"), F.col("queue_name").alias("arg"))
    second = queues.where("due").limit(1).select(F.lit("rotate_step2"), F.lit(None).cast("string"))
    extra = queues.select(F.explode("extra"), "queue_name")
    return rotate.union(second).union(extra).union(tables.select(F.lit("vacuum"), "table_name").distinct())


# ---- cooperation

def coop_next(main: DataFrame, members: DataFrame, asking: DataFrame, ticks: DataFrame, now: Column, dead_sec: float | None = None) -> DataFrame:
    """What each asking member (grp, member) of a cooperative consumer gets:
    (grp, member, action, next_tick, from_member).

    Its own open batch (own); else that of the sibling idle longest, if over
    dead_sec (takeover); else the group's next batch, whose main position moves
    on at once (new), or nothing (none). main: (grp, tick_queue, last_tick,
    batch); an open batch of main is an error. members: (grp, member, batch,
    next_tick, active). Members of a group that ask at once get batches in
    order of name, so that no two get the same.
    """
    mine = members.where("batch is not null").select("grp", "member", F.col("next_tick").alias("own"))
    a = asking.select("grp", "member").distinct().join(mine, ["grp", "member"], "left")
    turn = Window.partitionBy("grp").orderBy("member")
    need = a.where("own is null").select("grp", "member", F.row_number().over(turn).alias("k"))
    if dead_sec is None:
        dead = members.where("false")
    else:
        dead = members.where(F.col("batch").isNotNull() & ((F.unix_micros(now) - F.unix_micros("active")) / 1e6 > dead_sec)).join(asking, ["grp", "member"], "left_anti")
    oldest = Window.partitionBy("grp").orderBy("active", "member")
    dead = dead.select("grp", F.row_number().over(oldest).alias("k"), F.col("member").alias("from_member"), F.col("next_tick").alias("taken"))
    lost = dead.groupBy("grp").agg(F.count("*").alias("n_dead"))
    checked = main.select("grp", "tick_queue", F.coalesce(_error(F.col("batch").isNotNull(), "the main consumer has an open batch"), "last_tick").alias("last_tick"))
    after = Window.partitionBy("grp").orderBy("tick_id")
    news = checked.join(ticks.select("tick_queue", "tick_id"), "tick_queue").where("tick_id > last_tick").select("grp", F.row_number().over(after).alias("j"), F.col("tick_id").alias("fresh"))
    n = need.join(dead, ["grp", "k"], "left").join(lost, "grp", "left").withColumn("j", F.col("k") - F.coalesce("n_dead", F.lit(0))).join(news, ["grp", "j"], "left")
    got = a.join(n.select("grp", "member", "taken", "from_member", "fresh"), ["grp", "member"], "left")
    action = F.when(F.col("own").isNotNull(), "own").when(F.col("taken").isNotNull(), "takeover").when(F.col("fresh").isNotNull(), "new").otherwise("none")
    return got.select("grp", "member", action.alias("action"), F.coalesce("own", "taken", "fresh").alias("next_tick"), "from_member")


def coop_finish(members: DataFrame, batches: DataFrame) -> DataFrame:
    """members without the batches done (batch)."""
    j = members.join(batches.select("batch").distinct().withColumn("__done", F.lit(True)), "batch", "left")
    null = F.lit(None).cast("long")
    return j.select(*(F.when(F.col("__done"), null).otherwise(F.col(c)).alias(c) if c in ("batch", "next_tick") else F.col(c) for c in members.columns))


def coop_unregister(members: DataFrame, gone: DataFrame, drop_batch: bool) -> DataFrame:
    """members without those gone (grp, member); one with an open batch is an
    error, unless its batch is to be dropped."""
    g = gone.select("grp", "member", F.lit(True).alias("__gone"))
    j = members.join(g, ["grp", "member"], "left")
    bad = F.col("__gone").isNotNull() & F.col("batch").isNotNull() & F.lit(not drop_batch)
    stays = F.when(bad, F.raise_error("the member has an open batch").cast("boolean")).otherwise(F.col("__gone").isNull())
    return j.where(stays).select(*members.columns)


# ---- ledgers of exactly-once consumers

def events_not_done(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events (consumer, batch_id, ev_id, …) that a ledger of single events
    (consumer, batch_id, event_id) doesn't have. Only the latest batch of a
    consumer is remembered: a new batch forgets the one before."""
    latest = ledger.groupBy("consumer").agg(F.max("batch_id").alias("batch_id"))
    done = ledger.join(latest, ["consumer", "batch_id"]).select("consumer", "batch_id", F.col("event_id").alias("ev_id"))
    return events.join(done, ["consumer", "batch_id", "ev_id"], "left_anti")


def set_last_tick(ledger: DataFrame, ticks: DataFrame) -> DataFrame:
    """A ledger (consumer, last_tick) after ticks (consumer, last_tick); a null tick forgets the consumer."""
    return ledger.join(ticks.select("consumer"), "consumer", "left_anti").unionByName(ticks.where("last_tick is not null").select("consumer", "last_tick"))
