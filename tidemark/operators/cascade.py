"""Trees of nodes that copy a queue from one another: watermarks, topology,
copy coordination, lost events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a node does with its provider's queue, by its type and the type of the combined queue it feeds:
#: publishes the global watermark, handles batches, copies events, leaves out control events, keeps
#: event ids, makes ticks, reports ticks, waits until the combined queue has caught up.
ROLES = (
    ("root", None, True, False, False, False, False, False, False, False),
    ("branch", None, False, True, True, False, True, True, False, False),
    ("leaf", None, False, True, False, False, False, False, False, False),
    ("leaf", "root", False, True, True, True, False, False, True, False),
    ("leaf", "branch", False, True, False, False, False, False, False, True),
)


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "node_type string, combined_type string, publishes_watermark boolean, handles_batches boolean, copies_events boolean, filtered boolean, keeps_ids boolean, makes_ticks boolean, reports_ticks boolean, waits_behind boolean")


def local_watermark(nodes: DataFrame, consumers: DataFrame, ticks: DataFrame, publisher: str = ".global_watermark") -> DataFrame:
    """Per node the lowest tick that its consumers have done (the watermark's own
    publisher aside), its newest tick without consumers; a leaf's is the tick
    that it has completed itself. nodes: (node, node_type, completed_tick)."""
    low = consumers.groupBy("node").agg(F.min(F.when(F.col("consumer") != publisher, F.col("last_tick"))).alias("low"))
    top = ticks.groupBy("node").agg(F.max("tick_id").alias("top"))
    mark = F.when(F.col("node_type") == "leaf", F.col("completed_tick")).otherwise(F.coalesce("low", "top"))
    return nodes.join(low, "node", "left").join(top, "node", "left").select("node", mark.alias("local_watermark"))


def closure(nodes: DataFrame) -> DataFrame:
    """(node, below, depth): every node with all below it, itself at depth 0.
    nodes: (node, provider), the root's provider null or itself. One join per
    level of the tree."""
    parents = nodes.where("provider is not null and provider <> node").select(F.col("node").alias("child"), F.col("provider").alias("parent"))
    level = nodes.select("node", F.col("node").alias("below"), F.lit(0).alias("depth"))
    out, depth = level, 0
    while depth < 1000:
        depth += 1
        level = level.select("node", "below").join(parents, F.col("below") == F.col("parent")).select("node", F.col("child").alias("below"), F.lit(depth).alias("depth"))
        if not level.limit(1).count():
            return out
        out = out.union(level)
    raise ValueError("the nodes form a circle")


def global_watermark(nodes: DataFrame, local: DataFrame) -> DataFrame:
    """Per node the lowest local watermark of its subtree."""
    c = closure(nodes).join(local.toDF("below", "w"), "below")
    return c.groupBy("node").agg(F.min("w").alias("watermark"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Per node: nodes below it and levels of its subtree."""
    return closure(nodes).groupBy("node").agg((F.count("*") - 1).alias("total_childs"), (F.max("depth") + 1).cast("long").alias("levels"))


def tree_lines(nodes: DataFrame, root: str) -> list[str]:
    """The tree as indented text, small subtrees first; for people to read, so
    a tree of over 10 000 nodes is refused."""
    rows = nodes.join(tree_stats(nodes), "node").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many nodes to draw")
    below: dict[str, list] = {}
    for r in rows:
        if r["provider"] and r["provider"] != r["node"]:
            below.setdefault(r["provider"], []).append(r)
    out: list[str] = []

    def draw(name: str, lead: str, stem: str) -> None:
        out.append(lead + name)
        kids = sorted(below.get(name, []), key=lambda r: (r["levels"], r["total_childs"], r["node"]))
        for i, r in enumerate(kids):
            end = i == len(kids) - 1
            draw(r["node"], stem + "+--", stem + ("   " if end else "|  "))

    draw(root, "", "")
    return out


def copy_sources(nodes: DataFrame, complete: DataFrame) -> DataFrame:
    """(node, source): for every node but the root the nearest one up the tree
    among those complete (node), null where there is none."""
    up = closure(nodes).where("depth > 0").join(complete.select("node").distinct(), "node", "left_semi")
    near = up.groupBy(F.col("below").alias("n")).agg(F.min_by("node", "depth").alias("source"))
    below = nodes.where("provider is not null and provider <> node").select("node")
    return below.join(near, below["node"] == near["n"], "left").select("node", "source")


def copy_roles(parts: DataFrame) -> DataFrame:
    """parts (queue, table_name, state, dropped_ddl, local, combined) with
    copy_role and copy_pos: who copies first where several part queues fill one
    table of a combined queue (null: a queue without one).

    Only local parts that aren't ok count. The part that has dropped the
    table's DDL leads, else the first by name; alone, nobody has a role. The
    lead drops the DDL and copies while the others wait to copy; once any part
    is past copying, copies may run, and whoever is done waits to replay until
    the DDL is back. copy_pos: copying parts with smaller names, 0 for the lead.
    """
    other = F.col("local") & (F.col("state").isNull() | (F.col("state") != "ok"))
    whole = parts.where(other).groupBy("combined", "table_name").agg(F.min("queue").alias("first"), F.min(F.when(F.col("dropped_ddl").isNotNull(), F.col("queue"))).alias("first_ddl"), F.count("*").alias("n"), F.count(F.nullif("state", F.lit("in-copy"))).alias("done"), F.sort_array(F.collect_set(F.when(F.col("state") == "in-copy", F.col("queue")))).alias("copying"))
    g = whole.select(F.col("combined").alias("c"), F.col("table_name").alias("t"), "first", "first_ddl", "n", "done", "copying")
    j = parts.join(g, F.col("combined").eqNullSafe(F.col("c")) & (F.col("table_name") == F.col("t")), "left")
    lead = F.when(F.col("n") > 1, F.coalesce("first_ddl", "first"))
    copying, behind = F.col("state") == "in-copy", F.col("state") == "catching-up"
    open_, ddl = F.col("done") < F.col("n"), F.col("dropped_ddl").isNotNull()
    leads = F.when(copying & ~ddl & (F.col("done") > 0), "wait-replay").when(copying & open_, "lead").when(behind & ddl & open_, "wait-replay")
    follows = F.when(copying & (F.col("first_ddl").isNotNull() | (F.col("done") > 0)), "wait-replay").when(copying, "wait-copy").when(behind & F.col("first_ddl").isNotNull(), "wait-replay")
    role = F.when(lead.isNull(), F.lit(None)).when(F.col("queue") == lead, leads).otherwise(follows)
    place = F.when(copying & ~F.coalesce(F.col("queue") == lead, F.lit(False)), F.size(F.filter("copying", lambda q: q < F.col("queue")))).otherwise(0)
    return j.select("queue", "table_name", "state", role.alias("copy_role"), F.coalesce(place, F.lit(0)).alias("copy_pos"))


def state_counts(tables: DataFrame) -> DataFrame:
    """Tables by how far their copying is."""
    st = F.col("merge_state")
    return tables.agg(
        F.count_if(st.isNull()).alias("missing"),
        F.count_if(st == "in-copy").alias("copying"),
        F.count_if(st == "catching-up").alias("catching_up"),
        F.count_if(st.startswith("wanna-sync")).alias("wanna_sync"),
        F.count_if(st.startswith("do-sync")).alias("do_sync"),
        F.count_if(st == "ok").alias("ok"),
    )


def next_state(state: Column, lag_ticks: Column, reached: Column) -> Column:
    """The main process's next state of a table: a copy that has caught up is
    told where to stop, and is ok from there on."""
    return F.when(state.startswith("wanna-sync"), F.concat(F.lit("do-sync:"), F.element_at(F.split(state, ":"), 2))).when(state.startswith("do-sync") & reached, "ok").when((state == "catching-up") & (lag_ticks == 0), "ok").otherwise(state)


def ready_keys(pending: DataFrame, tables: DataFrame) -> DataFrame:
    """Parked foreign keys both of whose tables are complete."""
    ok = tables.where("merge_state = 'ok' and custom_snapshot is null").select("table_name")
    return pending.join(ok.withColumnRenamed("table_name", "from_table"), "from_table", "left_semi").join(ok.withColumnRenamed("table_name", "to_table"), "to_table", "left_semi")


def missing(present: DataFrame, registered: DataFrame) -> DataFrame:
    """Objects (kind, name) that exist and aren't registered."""
    return present.join(registered, ["kind", "name"], "left_anti")


def lost_stats(events: DataFrame) -> DataFrame:
    """Per table: inserts, updates, deletes of lost events, and whether all can
    be taken back: updates need a backup of the old row, deletes only where the
    event doesn't hold it (a bare D)."""
    op = F.substring("ev_type", 1, 1)
    bare = F.coalesce(F.col("ev_extra3"), F.lit("")) == ""
    lost = bare & ((op == "U") | (F.col("ev_type") == "D"))
    known = events.where(F.substring("ev_type", 1, 2).isin("I:", "U:", "D:", "I", "U", "D"))
    return known.groupBy("ev_extra1").agg(F.count_if(op == "I").alias("inserts"), F.count_if(op == "U").alias("updates"), F.count_if(op == "D").alias("deletes"), F.bool_and(~lost).alias("can_rollback"))
