"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors are dealt to shards; each shard builds a graph of its vectors; every
vector then searches every shard. Before that, an audit compares searches of
queries from the whole table with brute force, pooled over all shards, and
widens the beam until enough of the true links are found. Two shards search
each other in one task, so a link that either end finds counts at both; every
link found is verified by its cosine in double precision. Links are counted
and reduced to a spanning forest where they are found, so a group of close
vectors never leaves a task as its pairs. Exact copies of a vector are one
class throughout.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, lean_cogroup, lean_group, pinned
from .components import components

#: Links of a node on the upper layers (twice as many on the lowest); beam of the construction and of the first search.
M, BUILD_BEAM, BEAM = 12, 48, 32
#: Vectors of a shard at most, shards at least, vectors searched in one vector step.
SHARD, LEAST_SHARDS, BLOCK = 65_536, 8, 512
#: An audit begins with so many queries and doubles them until so many groups of linked ones are seen or all are in it; it passes at this recall.
AUDIT, LINKED, RECALL = 4096, 256, 0.995
#: Single-precision similarities this much under the threshold are verified, too.
SLACK = 1e-4


class Graph:
    """Built once over unit vectors in single precision; ids are rows of them.

    Rows are inserted layer by layer from the top, so a layer's entry points
    (the rows of the layer above) are in it before the others come, in batches
    that search the layer as it is and one another.
    """

    def __init__(self, unit: np.ndarray, seed: int = 11):
        n = len(unit)
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(r.random(n) + 1e-300) / math.log(M)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")  # inner row to given row
        self.v = np.ascontiguousarray(unit[self.order], np.float32)
        counts = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers: list[np.ndarray] = []  # lowest last
        for k in range(len(counts) - 1, -1, -1):
            self._layer(counts[k], 2 * M if k == 0 else M)

    def _layer(self, n: int, degree: int) -> None:
        links = np.full((n, degree), -1, np.int32)
        done = 0
        while done < n:
            size = min(n - done, max(32, min(256, done)))
            rows = np.arange(done, done + size)
            q = self.v[rows]
            own = q @ q.T
            # Only earlier rows of the batch, so each pair is offered once.
            own[np.triu_indices(size)] = -np.inf
            near = min(BUILD_BEAM, size)
            pick = np.argpartition(-own, near - 1, axis=1)[:, :near]
            ids, sims = rows[pick], np.take_along_axis(own, pick, 1)
            if done:
                entry = self._entry(q)  # of rows of the layer above, not all of which may be in this one yet
                found, close = self._beam(q, links[:done], np.where(entry < done, entry, 0), BUILD_BEAM)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, close], 1)
            chosen = self._diverse(ids, sims, degree // 2)
            links[rows, : degree // 2] = chosen
            done += size
            self._back(links, rows, chosen, degree)
        self.layers.append(links)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row up to most ids: the nearest first, each nearer to the row than
        to those taken before; then, where room is left, the nearest of the rest."""
        by = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        n, width = ids.shape
        taken = np.full((n, most), -1, np.int64)
        size = np.zeros(n, np.int64)
        used = np.zeros((n, width), bool)
        good = (sims > -np.inf) & (ids >= 0)
        for k in range(width):
            live = np.flatnonzero(good[:, k] & (size < most))
            if not len(live):
                continue
            c = ids[live, k]
            t = taken[live]
            between = np.einsum("nd,nkd->nk", self.v[c], self.v[t])
            between[t < 0] = -np.inf
            fresh = (t != c[:, None]).all(1)
            add = fresh & (between.max(1) < sims[live, k])
            go = live[add]
            taken[go, size[go]] = c[add]
            size[go] += 1
            used[live[~fresh | add], k] = True
        for k in range(width):
            live = np.flatnonzero(good[:, k] & ~used[:, k] & (size < most))
            if len(live):
                go = live[(taken[live] != ids[live, k][:, None]).all(1)]
                taken[go, size[go]] = ids[go, k]
                size[go] += 1
        return taken

    def _back(self, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray, degree: int) -> None:
        """Each chosen node links back; one with too many links chooses anew."""
        to, what = chosen.ravel(), np.repeat(rows, chosen.shape[1])
        to, what = to[to >= 0], what[chosen.ravel() >= 0]
        by = np.argsort(to, kind="stable")
        to, what = to[by], what[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 256):
            some = nodes[a : a + 256]
            most = int(count[a : a + 256].max(initial=0))
            more = np.full((len(some), most), -1, np.int64)
            place = np.arange(count[a : a + 256].sum()) - np.repeat(np.cumsum(count[a : a + 256]) - count[a : a + 256], count[a : a + 256])
            begin = first[a]
            more[np.repeat(np.arange(len(some)), count[a : a + 256]), place] = what[begin : begin + len(place)]
            ids = np.concatenate([links[some].astype(np.int64), more], 1)
            fits = (ids >= 0).sum(1) <= degree
            if fits.any():
                packed = np.take_along_axis(ids[fits], np.argsort(ids[fits] < 0, axis=1, kind="stable"), 1)
                links[some[fits]] = packed[:, :degree]
            full = np.flatnonzero(~fits)
            if len(full):
                sims = np.einsum("nd,nkd->nk", self.v[some[full]], self.v[ids[full]])
                sims[ids[full] < 0] = -np.inf
                links[some[full]] = self._diverse(ids[full], sims, degree)

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """For each query the best row of the layers above, by greedy descent."""
        at = np.zeros(len(q), np.int64)
        best = q @ self.v[0] if len(q) else np.zeros(0, np.float32)
        for links in self.layers:
            live = np.arange(len(q))
            while len(live):
                ids = links[at[live]]
                sims = np.einsum("nd,nkd->nk", q[live], self.v[ids])
                sims[ids < 0] = -np.inf
                k = sims.argmax(1)
                s = sims[np.arange(len(live)), k]
                up = s > best[live]
                go = live[up]
                at[go], best[go] = ids[up, k[up]], s[up]
                live = go
        return at

    def _beam(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the width best rows met per query, -1 where fewer."""
        n, nodes = len(q), len(links)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        opened = np.ones((n, width), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = entry, np.einsum("nd,nd->n", q, self.v[entry]), False
        seen = np.zeros((n, nodes), bool)
        seen[np.arange(n), entry] = True
        live = np.arange(n)
        while len(live):
            open_sims = np.where(opened[live], -np.inf, sims[live])
            k = np.argsort(-open_sims, axis=1)[:, :at_once]
            s = np.take_along_axis(open_sims, k, 1)
            going = s[:, 0] > -np.inf
            live, k, s = live[going], k[going], s[going]
            if not len(live):
                break
            opened[live[:, None], k] = True
            from_ids = np.where(s > -np.inf, ids[live[:, None], k], -1)
            near = np.where(from_ids[:, :, None] >= 0, links[from_ids], -1).reshape(len(live), -1)
            fresh = near >= 0
            fresh &= ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            # A row offered twice in one step counts once.
            key = r * np.int64(nodes) + near[r, c]
            _, one = np.unique(key, return_index=True)
            r, x = r[one], near[r[one], c[one]]
            seen[live[r], x] = True
            got = np.einsum("nd,nd->n", q[live[r]], self.v[x])
            most = int(np.bincount(r, minlength=len(live)).max(initial=0))
            if most:
                place = np.arange(len(r)) - np.searchsorted(r, r)
                new_ids, new_sims = np.full((len(live), most), -1, np.int64), np.full((len(live), most), -np.inf, np.float32)
                new_ids[r, place], new_sims[r, place] = x, got
                all_ids, all_sims = np.concatenate([ids[live], new_ids], 1), np.concatenate([sims[live], new_sims], 1)
                all_open = np.concatenate([opened[live], np.isneginf(new_sims)], 1)
                top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
                ids[live], sims[live], opened[live] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_open))
        return ids, sims

    def near(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, given row) of the pairs found with a similarity of at least
        least. A beam that is full of such rows is widened until it isn't."""
        if not len(q) or not len(self.v):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found_q, found_x = [], []
        entry = self._entry_all(q)
        live, w = np.arange(len(q)), width
        while len(live):
            if w >= len(self.v):  # the end of widening: a beam of all rows
                r, x = np.nonzero(q[live] @ self.v.T >= least)
                found_q.append(live[r])
                found_x.append(x)
                break
            ids, sims = self._beam(q[live], self.layers[-1], entry[live], w)
            good = sims >= least
            full = good.all(1)
            r, c = np.nonzero(good & ~full[:, None])
            found_q.append(live[r])
            found_x.append(ids[r, c])
            live, w = live[full], 4 * w
        return np.concatenate(found_q), self.order[np.concatenate(found_x)]

    def _entry_all(self, q: np.ndarray) -> np.ndarray:
        lowest = self.layers.pop()
        try:
            return self._entry(q)
        finally:
            self.layers.append(lowest)

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps((self.order, self.layers), protocol=5)

    @classmethod
    def load(cls, unit: np.ndarray, data: bytes) -> Graph:
        import pickle

        made = cls.__new__(cls)
        made.order, made.layers = pickle.loads(data)
        made.v = np.ascontiguousarray(unit[made.order], np.float32)
        return made


def audited(graph: Graph, q: np.ndarray, least: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(query, row, width, recall) of one graph: found with the first beam width
    whose mean recall of the queries with true rows passes; in the end that of
    brute force. All queries up to AUDIT are audited, spread over all."""
    some = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)) if len(q) else np.zeros(0, int)
    truth = _crossed(graph, q[some], least)
    n = len(graph.v)
    want = np.bincount(truth[0], minlength=len(some))
    while True:
        r, x = _near(graph, q[some], least, width)
        hit = np.isin(truth[0] * n + truth[1], r * n + x)
        got = np.bincount(truth[0][hit], minlength=len(some))
        recall = float((got[want > 0] / want[want > 0]).mean()) if want.any() else 1.0
        if recall >= RECALL or width >= n:
            break
        width *= 2
    return *_near(graph, q, least, width), width, recall


def _near(graph: Graph, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Graph.near, block by block."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(q), BLOCK):
        r, x = graph.near(q[i : i + BLOCK], least, width)
        a.append(r + i)
        b.append(x)
    return np.concatenate(a), np.concatenate(b)


def _crossed(graph: Graph, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same by brute force."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(q), BLOCK // 4):
        r, x = np.nonzero(q[i : i + BLOCK // 4] @ graph.v.T >= least)
        a.append(r + i)
        b.append(graph.order[x])
    return np.concatenate(a), np.concatenate(b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same ids as the edges (a, b), fewer than ids."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[other]], ids[other]


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec): key is null where the vector can't be compared."""

    def run(batches):
        import xxhash

        for batch in batches:
            keys, blobs = [], []
            for v in batch.column(1):
                good = v.is_valid and v.values.null_count == 0 and len(v.values)
                x = np.asarray(v.values, np.float64) + 0.0 if good else None
                if x is None or not np.isfinite(x).all() or not x.any() or not np.isfinite(x @ x) or not x @ x > 0:
                    keys.append(None)
                    blobs.append(None)
                else:
                    blobs.append(x.tobytes())
                    keys.append(xxhash.xxh3_128_digest(blobs[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["vec_id", "key", "vec"])

    return vectors.mapInArrow(lean(run), "vec_id long, key binary, vec binary")


def _stacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x, (x / np.sqrt((x * x).sum(1))[:, None])


def _graphs(table: pa.Table) -> pa.Table:
    """A shard: its ids, weights, vectors and graph, as one row."""
    table = table.sort_by("rep")
    x, unit = _stacked(table["vec"].to_pylist())
    row = {"dims": [table["dims"][0].as_py()], "shards": [table["shards"][0].as_py()], "shard": [table["shard"][0].as_py()], "ids": [np.asarray(table["rep"]).tobytes()], "weights": [np.asarray(table["n"]).tobytes()], "vectors": [x.tobytes()], "graph": [Graph(unit.astype(np.float32)).dump()]}
    return pa.table({**{k: pa.array(row[k], pa.int32()) for k in ("dims", "shards", "shard")}, **{k: pa.array(row[k], pa.binary()) for k in ("ids", "weights", "vectors", "graph")}})


class _Shard:
    """A row of _graphs, opened."""

    def __init__(self, row: dict):
        self.ids, self.weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        unit = self.x / self.norm[:, None]
        self.unit = unit.astype(np.float32)
        self.graph = Graph.load(unit, row["graph"])


def _linked(qx: np.ndarray, x: np.ndarray, norm: np.ndarray, r: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows of qx and x have a cosine of at least least."""
    good = np.zeros(len(r), bool)
    qn = np.sqrt((qx * qx).sum(1))
    for i in range(0, len(r), 1 << 16):
        s = slice(i, i + (1 << 16))
        good[s] = np.einsum("nd,nd->n", qx[r[s]], x[c[s]]) / (qn[r[s]] * norm[c[s]]) >= least
    return good


def _tallied(least: float, width: int):
    """Audit queries against a shard: per query the smallest id among its true
    links, itself left out, their number, and how many of them a search finds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            shard = _Shard(left.to_pylist()[0])
            mine, n = np.asarray(right["rep"]), len(shard.ids)
            qx, qu = _stacked(right["vec"].to_pylist())
            q = qu.astype(np.float32)
            r, c = _crossed(shard.graph, q, least - SLACK)
            true = _linked(qx, shard.x, shard.norm, r, c, least) & (mine[r] != shard.ids[c])
            r, c = r[true], c[true]
            a, b = _near(shard.graph, q, least - SLACK, width)
            hit = np.isin(r * n + c, a * n + b)
            low = np.full(len(mine), np.iinfo(np.int64).max)
            np.minimum.at(low, r, shard.ids[c])
            truth, got = np.bincount(r, minlength=len(mine)), np.bincount(r[hit], minlength=len(mine))
            some = np.flatnonzero(truth)
            out = [mine[some], low[some], truth[some], got[some]]
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in zip(("rep", "low", "truth", "got"), out, strict=True)})

    return run


def _searched(least: float, width: int):
    """Two shards, or one and itself: each searches the other's graph."""

    def run(table: pa.Table) -> pa.Table:
        shards = [_Shard(row) for row in table.sort_by("shard").to_pylist()]
        x, y = shards[0], shards[-1]
        n = len(y.ids)
        q, c = _near(x.graph, y.unit, least - SLACK, width)
        if x is y:
            keys = np.unique(np.minimum(q, c) * n + np.maximum(q, c))
        else:
            keys = c * n + q
            q, c = _near(y.graph, x.unit, least - SLACK, width)
            keys = np.unique(np.concatenate([keys, q * n + c]))
        r, c = keys // max(n, 1), keys % max(n, 1)
        good = (x.ids[r] != y.ids[c]) & _linked(x.x, y.x, y.norm, r, c, least)
        r, c = r[good], c[good]
        ends = [(x.ids, np.bincount(r, y.weights[c], minlength=len(x.ids))), (y.ids, np.bincount(c, x.weights[r], minlength=n))]
        ids, links = (np.concatenate(v) for v in zip(*ends, strict=True))
        some = np.flatnonzero(links)
        a, b = forest(x.ids[r], y.ids[c])
        # Counts are rows (id, null, n), tree edges rows (a, b, 0).
        out = {"a": [ids[some], a], "b": [np.full(len(some), -1), b], "n": [links[some], np.zeros(len(a), np.int64)]}
        return pa.table({k: pa.array(np.concatenate(v).astype(np.int64)) for k, v in out.items()})

    return run


def _audit(graphs: DataFrame, placed: DataFrame, least: float) -> dict:
    """The beam width for the search, and what its audit saw.

    Recall is the share of a query's true links in all shards that its own
    searches find, itself left out, of the queries that have any. It is
    averaged over queries and over groups, of queries with the same smallest
    id among themselves and their links; the lower mean counts, so neither a
    hot group nor the many small ones hide what the others lose. As the search
    takes what either end finds, it is a lower bound.
    """
    total = placed.count()
    top = graphs.agg(F.max(F.octet_length("ids")).alias("n")).first()["n"] // 8
    size, width = AUDIT, BEAM
    while True:
        size = min(size, total)
        share = F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 40)) < math.ceil(size / total * (1 << 40))
        groups = -(-size // SHARD)
        asked = placed.where(share).select("dims", "rep", "vec", F.pmod(F.xxhash64(F.col("rep"), F.lit(1)), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        spread = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = spread.groupBy("dims", "shard", "part").cogroup(asked.groupBy("dims", "shard", "part")).applyInArrow(lean_cogroup(_tallied(least, width)), "rep long, low long, truth long, got long")
        each = found.groupBy("rep").agg(F.least(F.col("rep"), F.min("low")).alias("low"), (F.sum("got") / F.sum("truth")).alias("r"))
        seen = each.groupBy("low").agg(F.avg("r").alias("g"), F.sum("r").alias("s"), F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").alias("linked"), F.avg("g").alias("g"), (F.sum("s") / F.sum("n")).alias("q")).first()
        if seen["groups"] < LINKED and size < total:
            size *= 2
            continue
        recall = min(seen["g"], seen["q"]) if seen["groups"] else None
        if recall is None or recall >= RECALL or width >= top:
            return {"width": width, "recall": recall, "queries": size, "linked": seen["linked"] or 0, "groups": seen["groups"]}
        width *= 2


def near_duplicates(vectors: DataFrame, least: float = 0.95, column: str = "embedding", record: dict | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths. Copies of a vector
    are linked with one another. Rows of one id count as different rows of the
    same vector id; a null id links with nothing, its component null, and is
    kept. Other columns are ignored; an empty table gives an empty table.
    What the audit of the search measured is logged and put into record.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    rows = pinned(_vectors(given))
    good = rows.where("key is not null and vec_id is not null")
    classes = pinned(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    if not classes.count():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Each length has shards of its own, LEAST_SHARDS at least where there are enough vectors for a block in each.
    most = F.greatest(F.ceil(F.count("*") / SHARD), F.least(F.lit(LEAST_SHARDS), F.ceil(F.count("*") / BLOCK)))
    sized = classes.groupBy(F.octet_length("vec").alias("dims")).agg(most.cast("int").alias("shards"))
    placed = classes.withColumn("dims", F.octet_length("vec")).join(F.broadcast(sized), "dims").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kinds = "dims int, shards int, shard int, ids binary, weights binary, vectors binary, graph binary"
    graphs = pinned(placed.select("dims", "shards", "shard", "rep", "n", "vec").groupBy("dims", "shard").applyInArrow(lean_group(_graphs), kinds))
    audit = _audit(graphs, placed, least)
    logging.getLogger(__name__).info("audit of the search: %s", audit)
    if record is not None:
        record.update(audit)
    # Every shard meets every other and itself: the stated query set is all vectors.
    met = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumns({"i": F.least("shard", "other"), "j": F.greatest("shard", "other")})
    out = pinned(met.groupBy("dims", "i", "j").applyInArrow(lean_group(_searched(least, audit["width"])), "a long, b long, n long"))
    edges, links = out.where("n = 0").select("a", "b"), out.where("n > 0").select("a", "n")
    comps = components(edges).toDF("rep", "c")
    summed = links.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    named = classes.select("key", "rep", "n").join(comps, "rep", "left").join(summed, "rep", "left").select("key", F.coalesce("c", "rep").alias("component"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    result = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return result.select("*", (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
