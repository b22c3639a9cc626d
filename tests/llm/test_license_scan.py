import re
import time

import numpy as np
import pytest

from tidemark.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels) from lists of words."""
    words = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for i in range(len(words)) for phrase, label in L.PHRASES if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns_match_brute_force_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert got.keys() == want.keys() and any(w[1] for w in want.values())
    for i, w in want.items():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == w
        assert set(filter(None, w[4].split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted({s.label for s in r.spans}))


def test_rows_of_all_kinds(spark):
    long = "a word " * 300_000 + "under the MIT license"
    texts = [None, "", "Under THE\nmit-license", "cc by nc cc by nc", "é under the mit license", "under the mit licenses", long]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, texts[2], "x", 2, "y"), (2, texts[2], "x", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score int, spans string").repartition(3)
    got = sorted((tuple(r)[:6] for r in L.scan(df).collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t, *_ in rows), key=repr)
    assert L.scan(df.limit(0)).count() == 0


def plainly(found, rules):
    kept = []
    for s, e, i in sorted(found, key=lambda x: (-rules[x[2]].priority, x[0] - x[1], found.index(x))):
        if rules[i].base or not any(a <= s and e <= b for a, b, _ in kept):
            kept.append((s, e, i))
    return sorted(kept)


def test_containment_matches_comparing_all_pairs():
    r = np.random.default_rng(8)
    rules = [L.Rule(f"w{i}", f"l{i}", int(r.integers(4)), 0.5, i == 0) for i in range(8)]
    for _ in range(200):
        n = int(r.integers(1, 25))
        s = r.integers(0, 30, n)
        found = sorted(zip(s.tolist(), (s + r.integers(1, 12, n)).tolist(), r.integers(0, 8, n).tolist(), strict=True))
        s, e, i = np.array(found).T
        keep = L.uncontained(s, e, np.array([x.priority for x in rules])[i], np.array([x.base for x in rules])[i])
        assert sorted(x for x, k in zip(found, keep, strict=True) if k) == plainly(found, rules)


@pytest.mark.parametrize("rule", L.rules(), ids=lambda r: f"{r.priority}-{r.label}-{r.pattern[:24]}")
def test_each_rule_finds_its_own_words(rule):
    text = rule.pattern.replace("[^\x00-\x1f]{1,120}?", "x").replace("[sc]", "s").replace("[sz]", "s").replace("[1-4] [05]", "4 0").replace("[01]", "0").replace(" ?", " ")
    while "(" in text:
        text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)
    text = text.replace("?", "")
    assert rule.words and any(L.scanner().rules[i] == rule for _, _, i in L.scanner().matches(f"so, {text}."))


def test_signatures():
    labels = lambda t: set(L.scan_text(t)[5].split(","))
    assert len(L.rules()) > 250 and len({r.pattern for r in L.rules()}) == len(L.rules())
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == {"gpl-2-plus"}  # the contained gpl-2 is suppressed
    assert labels("Licensed under the Apache License, Version 2.0") == {"apache-2"}
    assert labels("GPLv3, gpl v 3; zlib/libpng license") == {"gpl-3", "zlib"}
    assert labels("https://creativecommons.org/licenses/by-nc-sa/4.0/") == {"cc-by-nc-sa"}
    assert labels("a license to fish under water") == {""}


def test_time_grows_with_the_text():
    took = []
    for n in (4000, 16000):
        text = "Licensed under the MIT license. apache license version 2 cc by nc 4.0 " * n
        at = time.process_time()
        L.scan_text(text)
        took.append(time.process_time() - at)
    assert took[1] < 10 * took[0]
