import re

import numpy as np
import pytest

from tidemark.llm import minhash as M


def word_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [(i, word_set(t, k)) for i, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = sets[a][0] is not None and sets[a][0] == sets[b][0] and x and y
            if sets[a][0] is not None and sets[b][0] is not None and x and y and (same or 100 * len(x & y) >= 80 * len(x | y)):
                comp[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return sorted(((i, len(s), least[root(n)] if i is not None else None) for n, (i, s) in enumerate(sets)), key=repr)


def rows():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out, n = [], 0
    for _ in range(25):
        base = list(r.choice(vocabulary, int(r.integers(1, 120))))
        for _ in range(int(r.integers(1, 9))):
            text = list(base)
            for _ in range(int(r.integers(0, 1 + len(base) // 8))):
                text[int(r.integers(len(text)))] = str(r.choice(vocabulary))
            out.append((n, " ".join(text)))
            n += 1
    return out + [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "oNE\n"), (905, "one two"), (906, "É"), (907, "é"), (None, out[0][1]), (50, None)]


@pytest.mark.parametrize(("k", "block"), [(2, 4096), (5, 4096), (2, 4)])
def test_matches_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "ENVOYS", 2)
    given = rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, n_shingles string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(df, words=k).collect()), key=repr)
    assert got == brute(given, k)


@pytest.mark.parametrize("block", [1024, 8])
def test_long_chain_in_small_blocks(spark, monkeypatch, block):
    """Windows that slide over one text: neighbours are linked or only loosely
    alike, and canopies tie all of them into one candidate group."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "ENVOYS", 2)
    words = [f"c{i}" for i in np.random.default_rng(8).permutation(2000)]
    given, at = [], 0
    for n in range(120):
        given.append((n * 7 % 120, " ".join(words[at : at + 60])))
        at += (3, 5, 8, 12)[n % 4]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(df, words=2).collect()), key=repr)
    assert got == brute(given, 2)
    assert 3 < len({c for _, _, c in got}) < 120


def test_a_group_is_met_whole_or_by_canopies(spark, monkeypatch):
    """A chain of small canopies is met by canopies, three canopies that hold
    all of a group are not; each pair of a canopy that is open meets."""
    monkeypatch.setattr(M, "BLOCK", 4)
    chain = [(i, i + k) for i in range(0, 58, 2) for k in (1, 2)]
    hot = [(p, i) for p in (100, 101, 102) for i in range(p + 1, 130)]
    named = [(0, i, i) for i in range(59)] + [(100, i, 100 if i < 125 else i) for i in range(100, 130)]
    got = M._left_open(spark.createDataFrame(chain + hot, "a long, b long"), spark.createDataFrame(named, "grp long, id long, comp long")).collect()
    comp = {i: c for _, i, c in named}
    blocks = {}
    for r in got:
        assert r.comp == comp[r.id]
        blocks.setdefault((r.grp, r.block), set()).add(r.id)
    for p in {a for a, _ in chain + hot}:
        ids = [p] + [b for a, b in chain + hot if a == p]
        assert all(any({x, y} <= b for b in blocks.values()) for x in ids for y in ids if comp[x] != comp[y])
    assert max(map(len, (b for (g, _), b in blocks.items() if g < 100))) == 3
    assert {g for g, _ in blocks if g >= 100} == {100}


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 62, 1000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        a, b = x[:600], np.concatenate([x[: int(600 * share)], r.integers(0, 1 << 62, 600 - int(600 * share)).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = M.sketches([np.unique(a), np.unique(b)])
        assert abs((s[0] == s[1]).mean() - true) < 0.16
    few = M.sketches([x[:3], x[:1], x[:0]])
    assert (few[:2] != ~np.uint64(0)).all() and (few[2] == ~np.uint64(0)).all()


def test_empty_table_and_keep_one(spark):
    schema = "doc_id long, text string, lang string"
    assert M.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"t{i}" for i in range(60))
    df = spark.createDataFrame([(4, text, "a"), (2, text + " x", "b"), (9, "other", "c"), (10, None, "d"), (None, text, "e")], schema)
    assert sorted(r.lang for r in M.keep_one(df).collect()) == ["b", "c", "d", "e"]
