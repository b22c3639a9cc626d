"""MinHash near-dedup by fast similarity sketching.

A document's set is its distinct word shingles. A sketch has T bins filled in
rounds: in each of the first T rounds every element is hashed to one bin, in
round T + i every element goes to bin i, and a bin keeps the least (round,
hash) it has met; a document stops after the first round that leaves no bin
empty. So every coordinate is filled, and equal coordinates are as frequent as
the sets are similar, with Chernoff-like concentration. Bands of coordinates
name the candidates, sketches group them, and full sets confirm every link.

Copies of a set are one class from the start. A bucket (a band's value) is
never expanded into its pairs: its classes are tied to pivots by sketch, and
within the groups so made full sets are compared, in blocks, until nothing
outside a group's largest component is left to compare. What is lost is what
banding misses: at a similarity of 0.8, ROWS = 5 and BANDS = 32 miss
(1 - 0.8 ** 5) ** 32 = 3e-6 of the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap_of
from .common import lean, lean_group, pinned, sliced, utf8
from .components import components

ROWS, BANDS = 5, 32
T = ROWS * BANDS
#: Sketch agreements, five deviations from a similarity of 0.65 and of 0.45 = 0.65 - 0.2.
TIGHT, LOOSE = 0.8, 0.25
#: Rounds of pivots per bucket; classes compared in one block; members of a group that meet all its blocks.
TURNS, BLOCK, ENVOYS = 3, 4096, 16

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, the number of words before each document and in all)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~(inside[1:] & ~starts[1:])
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, n), out=total[1:])
    hashes = mix((total[b] - total[a]) * _powers(_INVERSE, n)[a] + (b - a).astype(np.uint64))
    return hashes, np.searchsorted(a, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 2) -> list[np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes. With fewer
    words than a shingle has, the whole sequence is the one shingle."""
    with np.errstate(over="ignore"):
        h, at = word_hashes(data, offsets)
        run = h.copy()
        for k in range(1, words):
            run[:-k] = mix(run[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(run[a : b - words + 1]))
            elif b > a:
                short = h[a : a + 1] + np.uint64(words)
                for k in range(a + 1, b):
                    short = mix(short * np.uint64(0xD6E8FEB86659FD93) + h[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Fast similarity sketches as rows of t coordinates; those of empty sets are all ones."""
    n = len(sets)
    out = np.full(n * t, ~np.uint64(0))
    live = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), live)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    left = np.where(live > 0, t, 0)
    with np.errstate(over="ignore"):
        for r in range(2 * t):
            if not len(x):
                break
            h = mix(x + np.uint64((r + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
            bins = (h % np.uint64(t)).astype(np.int64) if r < t else np.full(len(x), r - t)
            value = np.uint64(r) << np.uint64(54) | mix(h) >> np.uint64(10)
            np.minimum.at(out, owner * t + bins, value)
            if r % 4 == 3 or r < 4 or r >= t:  # a document past its last round only fails to improve full bins
                left = (out.reshape(n, t) == ~np.uint64(0)).sum(1)
                going = left[owner] > 0
                x, owner = x[going], owner[going]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        n, t = sketch.shape
        key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + np.uint64(1), (n, t // rows)).copy()
        for k in range(rows):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sketch[:, k::rows])
        return key


def small(sketch: np.ndarray) -> np.ndarray:
    """One byte of each coordinate, for estimates."""
    with np.errstate(over="ignore"):
        return (mix(sketch) & np.uint64(255)).astype(np.uint8)


def set_key(x: np.ndarray) -> bytes:
    """Size and two 64-bit sums of a set: equal for equal sets."""
    if not len(x):
        return bytes(24)
    with np.errstate(over="ignore"):
        h = mix(x)
        return np.array([len(x), h.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h + np.uint64(9)))], np.uint64).tobytes()


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in sliced(whole):
                sets = shingle_sets(*utf8(batch), words)
                s = sketches(sets)
                keys, marks = band_keys(s).view(np.int64), small(s)
                ids = [set_key(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([r.tobytes() for r in marks], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["doc_id", "n", "set_key", "marks", "keys"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, set_key binary, marks binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the sets wanted (id, set_key); a bounded bitmap of the
    ids spares other documents their shingles, and no text is shuffled."""
    known = bitmap_of(wanted.select("id").distinct())

    def run(batches):
        for whole in batches:
            for batch in sliced(whole):
                few = batch.filter(pa.array(known.has(np.asarray(batch.column(0).fill_null(0)))))
                sets = shingle_sets(*utf8(few), words) if few.num_rows else []
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set_key", "shingles"])

    found = docs.mapInArrow(lean(run), "id long, set_key binary, shingles binary")
    return found.join(wanted, ["id", "set_key"], "left_semi").dropDuplicates(["id", "set_key"]).select("id", "shingles")


def _scored(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """pairs (a, b) with est, the share of equal sketch coordinates."""
    both = pairs.join(marks.toDF("a", "ma"), "a").join(marks.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")

    def run(batches):
        for batch in batches:
            m, k = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, T) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((m == k).mean(1))], ["a", "b", "est"])

    return both.mapInArrow(lean(run), "a long, b long, est double")


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a bucket and
    can be similar enough: canopies around the buckets' pivots.

    A bucket's smallest id is its pivot. Members LOOSE to it are tied to it;
    those TIGHT to it are done, as whatever they are linked to is LOOSE to the
    pivot (1 - similarity is a metric). The rest take a pivot of their own;
    what the last round leaves of a bucket is tied together unseen. An edge
    per bucket, member and round at most, however large a bucket is.
    """
    marks = reps.select("id", "marks")
    members = reps.select("id", F.explode("keys").alias("key")).select("key", "id")
    edges = None
    for turn in range(TURNS + 1):
        pivots = members.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
        rows = members.join(pivots, "key").where("id <> pivot").select("key", "pivot", "id")
        rows = pinned(rows)
        pairs = rows.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        if turn == TURNS:
            return pinned(edges.union(pairs).distinct())
        scored = pinned(_scored(pairs, marks))
        near = scored.where(F.col("est") >= LOOSE).select("a", "b")
        edges = near if edges is None else edges.union(near)
        left = scored.where(F.col("est") < TIGHT).select(F.col("a").alias("pivot"), F.col("b").alias("id"))
        members = rows.join(left, ["pivot", "id"], "left_semi").select("key", "id")
    raise AssertionError


def link_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, comps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the ids which links reach within these sets.

    One query compares a set in full with all others, by shared shingles. The
    most central set asks first; then only sets outside the largest component
    need to: every pair of different components has one of those. comps: ids
    known to be connected already.
    """
    m = len(ids)
    sizes = np.array([len(x) for x in sets], np.int64)
    unique, codes = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.cumsum(sizes) - sizes
    label = np.arange(m) if comps is None else np.unique(comps, return_inverse=True)[1].astype(np.int64)
    given = label.copy()
    central = np.add.reduceat(np.bincount(codes)[codes], bounds) / sizes
    todo, asked = np.argsort(-central, kind="stable"), np.zeros(m, bool)
    held = np.zeros(len(unique), bool)
    first = True
    while True:
        largest = np.bincount(label).argmax()
        waiting = todo[~asked[todo] & (first | (label[todo] != largest))]
        if not len(waiting):
            break
        for i in waiting.tolist():
            if not first and label[i] == largest:
                continue
            mine = codes[bounds[i] : bounds[i] + sizes[i]]
            held[mine] = True
            common = np.add.reduceat(held[codes], bounds, dtype=np.int64)
            held[mine] = False
            asked[i] = True
            near = 100 * common >= percent * (sizes[i] + sizes - common)
            found = np.unique(label[near])
            if len(found) > 1:
                to = largest if largest in found else found[0]
                label[np.isin(label, found)] = to
            if first:
                first = False
                break
    # Per new component: a star over one id of each component that it was made of.
    _, one = np.unique(given, return_index=True)
    roots = {c: int(ids[label == c].min()) for c in np.unique(label[one]).tolist()}
    ends = np.array([roots[c] for c in label[one].tolist()], np.int64)
    keep = ends != ids[one]
    return ends[keep], ids[one][keep]


def _tied(rows: DataFrame, percent: int) -> DataFrame:
    """rows (grp, block, id, comp, shingles): the edges of each block's links."""

    def run(table: pa.Table) -> pa.Table:
        # A member may have come as a guest, too; an id may have several sets.
        rows = list(set(zip(*(table[k].to_pylist() for k in ("id", "comp", "shingles")), strict=True)))
        rows.sort(key=lambda r: (r[0], r[2]))
        a, b = link_forest(np.array([r[0] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], percent, np.array([r[1] for r in rows]))
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

    return rows.groupBy("grp", "block").applyInArrow(lean_group(run), "a long, b long")


def _met(rows: DataFrame) -> DataFrame:
    """rows (grp, id, comp, of) of groups, with their groups' figures: top, the
    largest component, n, blocks, and cost, the rows that _dealt makes of them."""
    sizes = rows.groupBy("of", "grp", "comp").agg(F.count("*").alias("m"))
    sums = sizes.groupBy("of", "grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.sum("m").alias("n"), F.max("m").alias("most")).where("most < n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return sums.select("of", "grp", "top", blocks.alias("blocks"), (F.col("n") + F.when(blocks > 1, (F.col("n") - F.col("most")) * blocks).otherwise(0)).alias("cost"))


def _dealt(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(grp, id, block, comp): a row in its own block and, if it is outside its
    group's largest component, in all of the group's blocks."""
    marked = rows.join(met.select("of", "grp", "top", "blocks"), ["of", "grp"])
    home = marked.select("grp", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "comp")
    away = marked.where("comp <> top and blocks > 1").select("grp", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "comp")
    return home.union(away)


def _left_open(edges: DataFrame, named: DataFrame) -> DataFrame:
    """What is still to be compared in large groups, named (grp, id, comp), as
    (grp, id, block, comp).

    Either a whole group's blocks are met, or those of its canopies, a pivot
    with what is LOOSE to it: any pair that can be linked lies in one. Few
    canopies that each hold most of the group cost more than the group itself;
    many small ones that chain together cost their sum, where the group would
    cost its square. Each group takes the cheaper way.
    """
    whole = named.withColumn("of", F.col("grp"))
    ties = edges.toDF("grp", "id").join(named.select(F.col("id").alias("grp")), "grp", "left_semi")
    ends = ties.union(ties.select("grp", F.col("grp").alias("id")).distinct())
    canopies = pinned(ends.join(named.select("id", "comp", F.col("grp").alias("of")), "id").select("grp", "id", "comp", "of"))
    of_whole, of_canopies = pinned(_met(whole)), pinned(_met(canopies))
    other = of_canopies.groupBy("of").agg(F.sum("cost").alias("sum"))
    split = pinned(of_whole.join(other, "of").where("sum < cost").select("of"))
    return _dealt(whole, of_whole.join(split, "of", "left_anti")).union(_dealt(canopies, of_canopies.join(split, "of", "left_semi")))


def _links(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes, whose components are those of all links.

    Each candidate group is compared in blocks of bounded size. First a block
    meets itself and a few members of its whole group, which ties the blocks'
    large components together. That settles groups of one block. In larger
    ones what is outside the largest component meets what is left to meet.
    """
    edges = _candidates(reps)
    groups = pinned(components(edges).toDF("id", "grp"))
    sets = pinned(_sets(docs, reps.select("id", "set_key").join(groups, "id", "left_semi"), words))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = pinned(groups.join(sizes, "grp").select("grp", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    w = F.xxhash64("id", F.lit(7))
    envoys = placed.where("blocks > 1").groupBy("grp", "blocks").agg(F.slice(F.sort_array(F.collect_list(F.when(F.pmod(w, F.col("blocks") * (BLOCK // ENVOYS)) == 0, F.struct(w.alias("w"), "id")))), 1, 2 * ENVOYS).alias("e"))
    guests = envoys.select("grp", F.explode("e.id").alias("id"), "blocks").select("grp", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    once = placed.select("grp", "id", "block").union(guests).join(sets, "id").select("grp", "block", "id", F.col("id").alias("comp"), "shingles")
    links = pinned(_tied(once, percent))
    big = placed.where("blocks > 1")
    if not big.limit(1).count():
        return links
    comps = pinned(components(links)).toDF("id", "comp")
    named = pinned(big.join(comps, "id", "left").select("grp", "id", F.coalesce("comp", "id").alias("comp")))
    again = _left_open(edges, named).join(sets, "id").select("grp", "block", "id", "comp", "shingles")
    return links.union(pinned(_tied(again, percent)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * common >= percent * united shingles; a
    component is what links reach, its id the smallest doc_id in it, and the
    row of that id is kept. Texts without words (null and empty ones too) link
    with nothing and are kept. Exact copies of a set are one class, so a hot
    group of copies costs one sketch comparison a copy. Repeated ids are one
    document for links, and each row is returned; a row with a null id links
    with nothing and is kept, its component null. Other columns are ignored;
    an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = pinned(_signatures(docs, words))
    full = sig.where("n > 0 and doc_id is not null")
    classes = pinned(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes, "set_key").where("doc_id = rep").select(F.col("doc_id").alias("id"), "set_key", "marks", "keys").dropDuplicates(["id", "set_key"])
    reps = pinned(reps)
    comps = pinned(components(_links(docs, reps, words, percent)))
    named = classes.join(comps.toDF("rep", "c"), "rep", "left").select("set_key", F.coalesce("c", "rep").alias("component"))
    out = sig.join(named, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("*", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that a smaller doc_id of their component stands
    for, with docs' own columns. A bounded bitmap of the dropped ids lets most
    rows pass unshuffled; the rest are anti-joined."""
    gone = pinned(near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    known = bitmap_of(gone)

    @F.pandas_udf("boolean")
    def maybe(i):
        import pandas as pd

        return pd.Series(known.has(i.fillna(0).to_numpy(np.int64)))

    tested = docs.select("*", (F.col("doc_id").isNotNull() & maybe(F.col("doc_id").cast("long"))).alias("__m_maybe"))
    clear = tested.where("not __m_maybe").drop("__m_maybe")
    asked = tested.where("__m_maybe").drop("__m_maybe")
    return clear.union(asked.join(gone, asked["doc_id"] == gone["id"], "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
