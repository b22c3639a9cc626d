"""Each stage of the pipeline against a plain version, on documents of all kinds."""

import collections
import re

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from tidemark.llm import quality_classifier as Q
from tidemark.llm import quality_rules as R

from .test_minhash import word_set

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, spans string"


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = max((g for g in given if g[2] == "en"), key=lambda g: (len(set(g[1].split())) / len(g[1].split()), -g[0]))[1]
    good = " ".join(["the and of", *(f"{w} the" for w in good.split()[:80])])
    more = [(None, good), (9001, None), (9002, ""), (9003, good), (9003, good), (9004, good + " again"), (9005, None), (9006, " ".join(f"the {i} of w{i}" for i in range(30_000))), (9007, good.upper()), (None, None)]
    return [(*g, True, 1, "x") for g in given] + [(i, t, "en", None, len(t) if t else None, False, 2, None) for i, t in more]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def ids(rows):
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def passes(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    at = collections.defaultdict(list)
    for i in range(n - 2):
        at[tuple(words[i : i + 3])].append(i)
    again = {j for x in at.values() if len(x) > 1 for i in x for j in (i, i + 1, i + 2)}
    if n < 50 or 100 * len(again) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    stop = sum(re.sub('[.,;:!?"()]', "", w).lower() in R.STOP_WORDS for w in words)
    measure = {"mean_word_length": sum(map(len, words)) / n, "symbols_per_word": sum(c in R.SYMBOLS for c in text) / n, "stop_word_ratio": stop / n, "duplicate_line_ratio": (len(lines) - len(set(lines))) / len(lines), "shouting_ratio": text.count("!") / n}
    return all((r.low is None or measure[r.name] >= r.low) and (r.high is None or measure[r.name] <= r.high) for r in R.RULES)


def test_rules(spark, docs, rows):
    got = C.by_rules(spark, docs, SF)
    assert got.columns == docs.columns and ids(got.collect()) == ids(r for r in rows if passes(r[1]))
    assert C.by_rules(spark, docs.limit(0), SF).count() == 0


def test_classifier(spark, docs, rows):
    net = Q.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    one = lambda t: net.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    got = C.by_classifier(spark, docs, SF)
    scores = {r[1]: one(r[1]) for r in rows}
    sure = lambda rs: ids(r for r in rs if abs(scores[r[1]] - Q.THRESHOLD) > 1e-4)
    assert got.columns == docs.columns and sure(got.collect()) == sure(r for r in rows if scores[r[1]] >= Q.THRESHOLD)
    assert C.by_classifier(spark, docs.limit(0), SF).count() == 0


def test_near_copies(spark, docs, rows):
    sets = [(i, word_set(t, 5)) for i, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and j is not None and x and y and (i == j or 100 * len(x & y) >= 80 * len(x | y)):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, x) in enumerate(sets):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    want = ids(r for n, r in enumerate(rows) if r[0] is None or not sets[n][1] or least[root(n)] == r[0])
    got = C.without_near_copies(spark, docs, SF)
    assert got.columns == docs.columns and ids(got.collect()) == want and len(want) < len(rows)
    assert C.without_near_copies(spark, docs.limit(0), SF).count() == 0


def test_repeats(spark, docs, rows):
    big = (1 << 63) - 1
    data = [(big if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            if first.get(w, big) > i:
                first[w] = i
    want = []
    for (i, b), r in zip(data, rows, strict=True):
        keep = np.ones(len(b), bool)
        for s in range(len(b) - 49):
            if first.get(b[s : s + 50], big) < i:
                keep[s : s + 50] = False
        text = r[1] if keep.all() else np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
        want.append((r[0], text, r[4] if keep.all() else len(text)))
    got = C.without_repeats(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert C.without_repeats(spark, docs.limit(0), SF).count() == 0


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [len(x.ids) + 1 for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def tiled(pieces, want):
    """Pieces cover documents of so many tokens each, and sequences from 0 without gaps."""
    n, by_doc, by_sequence = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
        if r.start == 0:
            n[r.doc_id, r.doc_tokens] += 1
    assert n == collections.Counter(want)
    assert by_doc == sum((collections.Counter({i: k}) for i, k in want), collections.Counter())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, docs, rows):
    tiled(C.packed(spark, docs, SF).collect(), list(zip((r[0] for r in rows), tokens(r[1] for r in rows), strict=True)))
    assert C.packed(spark, docs.limit(0), SF).count() == 0


def test_whole_run(spark):
    """run() gives what the stages give one after another, each on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    kept = docs.collect()
    assert 0 < len(kept) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tiled(C.run(spark, SF).collect(), list(zip((r.doc_id for r in kept), tokens(r.text for r in kept), strict=True)))
