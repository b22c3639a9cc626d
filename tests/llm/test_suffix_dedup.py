import hashlib

import numpy as np

from tidemark.llm import suffix_dedup as S

N = S.LENGTH


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by trying every window."""
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for s in range(len(b) - N + 1):
            w = b[s : s + N]
            least[w] = min(least.get(w, S.NO_DOC), S.NO_DOC if i is None else i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - N + 1):
            if least[b[s : s + N]] < (S.NO_DOC if i is None else i):
                gone[s : s + N] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdé ü日"), r.integers(1, 6))) for _ in range(40)]
    make = lambda n: " ".join(r.choice(words, n))
    base = [make(int(n)) for n in r.integers(0, 120, 60)]
    shared = make(30)
    rows = list(enumerate(base))
    rows += [(100 + i, make(5) + shared + make(7)) for i in range(12)]
    rows += [(200 + i, base[3]) for i in range(5)] + [(300, "x" * 400), (301, "x" * 49), (302, "x" * 50), (303, "xy" * 300)]
    rows += [(400, None), (401, ""), (None, base[3]), (None, make(20)), (3, base[3]), (150, shared + "!" + base[4])]
    return rows


def test_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n_bytes string, chunk int").repartition(3)
    got = sorted(map(tuple, S.dedup(df).collect()), key=repr)
    assert got == brute(rows)


def test_small_chunks_and_blocks(spark, monkeypatch):
    rows = texts()
    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len((t or "").encode()) for _, t in rows)])
    whole = S.runs(data, offsets)
    monkeypatch.setattr(S, "BLOCK", 64)
    cut = S.runs(data, offsets)
    assert whole[2].sum() == cut[2].sum() == sum(max(0, n - N + 1) for n in np.diff(offsets))


def test_deep_shallow_orders_suffixes():
    r = np.random.default_rng(0)
    data = np.frombuffer(b"".join([b"abcab" * 30, r.integers(97, 99, 900).astype(np.uint8).tobytes(), b"a" * 200]), np.uint8)
    starts = np.arange(len(data) - N + 1)
    order, group = S.deep_shallow(data, starts)
    strings = [data[s : s + N].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings)
    assert all((strings[order[i]] == strings[order[i + 1]]) == (group[i] == group[i + 1]) for i in range(len(order) - 1))


def test_empty_table_and_cut_keeps_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert S.dedup(spark.createDataFrame([], schema)).count() == 0
    assert S.cut_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "".join(chr(97 + i % 23) + chr(98 + i % 7) for i in range(100))
    rows = [(1, long, "a", "s", 200), (2, "é" + long + "ü", "b", "s", 202), (3, None, None, None, None), (None, long, "c", "s", 200)]
    out = {(r.doc_id, r.lang): r for r in S.cut_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert out[1, "a"].text == long and out[2, "b"].text == "éü" and out[2, "b"].n_chars == 2
    assert out[3, None].text is None and out[None, "c"].text == ""
