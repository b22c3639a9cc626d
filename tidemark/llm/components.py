"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


#: A node with over this share of all edge ends is a hub; there are at most 1 / HUB of them.
HUB = 1 / 1000


def _handed(edges: DataFrame, node: str, least: DataFrame, ends: int) -> DataFrame:
    """edges with m, the smallest neighbour of their column node, of least
    (node, m, n). Hubs' rows are joined by broadcast: there are few hubs
    whatever the table's size, and no task gets a hub's rows together."""
    hub = F.col("n") > ends * HUB
    near = edges.join(F.broadcast(least.where(hub).select(F.col(node).alias("__h"), F.col("m").alias("__m"))), F.col(node) == F.col("__h"), "left")
    few = near.where("__h is null").select(*edges.columns).join(least.where(~hub).select(node, "m"), node)
    return near.where("__h is not null").select(*edges.columns, F.col("__m").alias("m")).unionByName(few)


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return _handed(both.where("v > u"), "u", least, 2 * n).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    joined = _handed(edges, "b", least, n)
    return joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m"), F.col("b"))).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), component the smallest
    node reachable. Rows with a null, a loop or a repeated pair add nothing;
    an empty table gives an empty table.

    The edge count never grows, hubs' rows stay where they are, and every
    round is written to the shared folder; only two numbers per round reach
    the driver.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = pinned(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), a.isNull().alias("n1"), b.isNull().alias("n2")).where("not n1 and not n2 and a < b").select("a", "b").distinct())
    mark, n = None, now.count()
    for _ in range(most_rounds):
        now = pinned(_small(pinned(_large(now, n)), n))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
        mark, n = (seen["n"], seen["s"]), seen["n"]
    raise RuntimeError("star contraction did not settle")
