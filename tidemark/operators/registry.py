"""Which tables, sequences, scripts and nodes take part, and what may be done
with them: decision rules as columns over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """state with rows of the same columns added or replaced; the last of all registries' create and change steps."""
    return state.join(rows.select(*key), key, "left_anti").select(*state.columns).unionByName(rows.select(*state.columns))


def remove(state: DataFrame, gone: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state without rows gone, (key…, code)): 200 where there was one, else 404."""
    there = state.select(*key).distinct().withColumn("__there", F.lit(200))
    codes = gone.select(*key).distinct().join(there, key, "left").select(*key, F.coalesce("__there", F.lit(404)).alias("code"))
    return state.join(gone.select(*key), key, "left_anti").select(*state.columns), codes


# ---- tables

def add_table(requests: DataFrame) -> DataFrame:
    """requests with code and new_state: may a table be added to a node?

    Columns: merge_all, no_merge, virtual, exists, has_key, sibling_dropped
    (another part queue of the table holds dropped DDL), node_type (null: no
    such queue), combined_type, registered, local, attrs, old_attrs,
    expect_sync, n_sources (other part queues that have the table), n_local
    (those where it is local). new_state is null where the data must be copied.
    """
    c = F.col
    fed = F.coalesce(c("combined_type") == "branch", F.lit(False))
    ready = (c("node_type") == "root") | ((c("node_type") == "leaf") & fed) | c("expect_sync")
    merges = (c("node_type") == "leaf") & ~c("no_merge") & ~ready
    code = (
        F.when(c("merge_all") & c("no_merge"), 405)
        .when(~c("virtual") & ~c("exists"), 404)
        .when(~c("virtual") & ~c("has_key") & ~c("sibling_dropped"), 400)
        .when(c("node_type").isNull(), 400)
        .when(~c("registered") & (c("node_type") != "root"), 404)
        .when(c("registered") & c("local"), F.when(c("attrs").eqNullSafe(c("old_attrs")), 200).otherwise(410))
        .when(merges & (c("n_local") > 0), 405)
        .when(merges & (c("n_sources") > 0) & ~c("merge_all"), 405)
        .otherwise(200)
    )
    was = c("registered") & c("local")
    return requests.select("*", code.alias("code")).select("*", F.when((c("code") == 200) & ~was & ready, "ok").alias("new_state"))


def foreign_keys(columns: DataFrame) -> DataFrame:
    """Per foreign key its columns in order: (from_table, to_table, key_name,
    from_columns, to_columns), of a catalog's rows with a position."""
    g = columns.groupBy("from_table", "to_table", "key_name").agg(F.sort_array(F.collect_list(F.struct("position", "from_column", "to_column"))).alias("c"))
    names = lambda k: F.transform("c", lambda x: x[k])
    return g.select("from_table", "to_table", "key_name", names("from_column").alias("from_columns"), names("to_column").alias("to_columns"))


def expand_globs(patterns: list[str], names: DataFrame, have: DataFrame) -> DataFrame:
    """Names (name) that the patterns mean (* and ?), each with whether it is
    there and not yet in have: (name, found, present). Plain names stay, found or not."""
    import re

    plain = [p for p in patterns if not re.search(r"[*?]", p)]
    globs = [p for p in patterns if p not in plain]
    regex = "|".join("^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in p) + "$" for p in globs) or "^$."
    asked = names.sparkSession.createDataFrame([(p,) for p in plain], "name string").union(names.where(F.col("name").rlike(regex)).select("name")).distinct()
    found, present = names.select("name", F.lit(True).alias("found")).distinct(), have.select("name", F.lit(True).alias("present")).distinct()
    return asked.join(found, "name", "left").join(present, "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("present", F.lit(False)).alias("present"))


# ---- sequences

def publish_sequences(seqs: DataFrame, buffer: int) -> DataFrame:
    """Sequences (name, last_value, real) whose real value comes within buffer
    of the published one, with the value to publish."""
    return seqs.where(F.col("real") + buffer >= F.col("last_value")).select("name", (F.col("real") + 3 * buffer).alias("last_value"))


def apply_sequences(seqs: DataFrame, published: DataFrame) -> DataFrame:
    """seqs (name, last_value) after published values; never backwards."""
    p = published.groupBy("name").agg(F.max("last_value").alias("__new"))
    return seqs.join(p, "name", "left").select("name", F.greatest("last_value", F.coalesce("__new", "last_value")).alias("last_value"))


# ---- scripts

def scripts_to_run(scripts: DataFrame, done: DataFrame, now: Column, keep_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(scripts with code, the ledger kept): 201 for a script (queue, file) that
    the ledger done (queue, file, at) has, else 200; entries over keep_days old go."""
    seen = done.select("queue", "file", F.lit(201).alias("__c")).distinct()
    coded = scripts.join(seen, ["queue", "file"], "left").select(*scripts.columns, F.coalesce("__c", F.lit(200)).alias("code"))
    return coded, done.where((F.unix_micros(now) - F.unix_micros("at")) / 86400e6 <= keep_days)


def script_attributes(sql: str) -> dict[str, list[str]]:
    """Attributes in a script's leading comments: ``--*-- Key: a, b``."""
    import re

    out: dict[str, list[str]] = {}
    for line in sql.splitlines():
        if not line.strip():
            continue
        if not line.lstrip().startswith("--"):
            break
        if m := re.match(r"\s*--\*--\s*([\w-]+)\s*:\s*(.*)$", line):
            out.setdefault(m[1].lower(), []).extend(x.strip() for x in m[2].split(",") if x.strip())
    return out


def script_needed(found: dict[str, list[bool]]) -> bool:
    """Whether a script runs, by which of its attributes' objects are there: all
    of local-* ones, or none (it is skipped); need-* ones must be. Some of the
    local ones is an error."""
    local = [x for k, v in found.items() if k.startswith("local-") for x in v]
    needed = [x for k, v in found.items() if k.startswith("need-") for x in v]
    if local and any(local) and not all(local):
        raise ValueError("only some of the script's objects are here")
    if local and not any(local):
        return False
    if not all(needed):
        raise ValueError("an object that the script needs is not here")
    return True


def handler_arguments(text: str) -> tuple[str, dict[str, str]]:
    """``name(k=v&k2=v2)``: a comma will do for &; a repeated argument is an error."""
    from urllib.parse import unquote_plus

    name, _, rest = text.partition("(")
    out: dict[str, str] = {}
    for part in filter(None, rest.removesuffix(")").replace(",", "&").split("&")):
        key, _, value = part.partition("=")
        if key in out:
            raise ValueError(f"argument given twice: {key}")
        out[unquote_plus(key)] = unquote_plus(value)
    return name.strip(), out


# ---- nodes

def node_info(nodes: DataFrame, local_state: DataFrame, locations: DataFrame, consumers: DataFrame, ticks: DataFrame, publisher: str = ".global_watermark") -> DataFrame:
    """Per node (queue, node_type, node, worker, combined): its combined queue's
    type, provider and its location, worker's tick, watermarks. local_state:
    (queue, consumer, provider, last_tick); consumers: (queue, consumer, last_tick)."""
    comb = nodes.select(F.col("queue").alias("combined"), F.col("node_type").alias("combined_type"))
    state = local_state.select("queue", F.col("consumer").alias("worker"), "provider", F.col("last_tick").alias("worker_tick"))
    place = locations.select("queue", F.col("node").alias("provider"), "location")
    own = F.col("consumer") == publisher
    marks = consumers.groupBy("queue").agg(F.min(F.when(~own, F.col("last_tick"))).alias("low"), F.min(F.when(own, F.col("last_tick"))).alias("wm"))
    top = ticks.groupBy("queue").agg(F.max("tick_id").alias("top"))
    j = nodes.join(comb, "combined", "left").join(state, ["queue", "worker"], "left").join(place, ["queue", "provider"], "left").join(marks, "queue", "left").join(top, "queue", "left")
    inner = F.col("node_type").isin("root", "branch")
    return j.select(
        "queue", "node", "node_type", "combined_type", "provider", "location", F.when(F.col("node_type") == "root", F.col("top")).otherwise(F.col("worker_tick")).alias("worker_tick"),
        F.when(inner, F.coalesce("low", "top")).otherwise(F.col("worker_tick")).alias("local_watermark"), F.when(inner, F.col("wm")).alias("global_watermark"),
    )


def set_subscriber_watermark(current: Column, wanted: Column) -> Column:
    """404 without a subscription, 405 backwards, 100 where it is already, else 200."""
    return F.when(current.isNull(), 404).when(wanted < current, 405).when(wanted == current, 100).otherwise(200)


def set_global_watermark(node_type: Column, wanted: Column, local: Column, tick_known: Column) -> Column:
    """struct(code, watermark): the root takes its local one where none is
    given; a branch needs one and skips a tick that it doesn't have; a leaf ignores it."""
    code = F.when(node_type.isNull(), 404).when(node_type == "root", 200).when(node_type != "branch", 100).when(wanted.isNull(), 500).otherwise(200)
    mark = F.when(node_type == "root", F.coalesce(wanted, local)).when((node_type == "branch") & tick_known, wanted)
    return F.struct(code.alias("code"), mark.alias("watermark"))


def watermark_due(lag_sec: Column, every: float = 300.0) -> Column:
    return lag_sec >= every


def may_pass(completed: Column, tick: Column) -> Column:
    """Does a leaf that follows a combined branch handle this tick yet? Only once the branch has completed it."""
    return F.coalesce(completed >= tick, F.lit(False))


def branch_ticks(done: DataFrame, have: DataFrame) -> DataFrame:
    """Ticks (queue, tick_id, tick_time, ev_seq) of done batches that a branch
    must make, with their id, time and sequence: those it doesn't have. A branch
    behind its newest tick is an error."""
    top = have.groupBy("queue").agg(F.max("tick_id").alias("__top"))
    j = done.join(top, "queue", "left")
    return j.where(F.col("__top").isNull() | (F.col("tick_id") > F.col("__top"))).select(*done.columns)


def failover(nodes: DataFrame, dead: str, candidate: str) -> DataFrame:
    """After a root's death: (node, provider) of its subscribers. If another one
    has got further than the candidate, the candidate first catches up from it;
    the others go under the candidate. nodes: (node, provider, last_tick)."""
    direct = nodes.where((F.col("provider") == dead) & (F.col("node") != dead))
    best = direct.agg(F.max_by("node", F.struct("last_tick", (F.col("node") == candidate).alias("c"))).alias("ahead"))
    j = direct.crossJoin(F.broadcast(best))  # one row
    first = F.when(F.col("ahead") != candidate, F.col("ahead"))
    return j.select("node", F.when(F.col("node") == candidate, first).otherwise(F.lit(candidate)).alias("provider"))
