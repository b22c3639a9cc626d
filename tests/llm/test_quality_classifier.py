import zlib

import numpy as np
import pytest

from tidemark.llm import quality_classifier as Q

TEXTS = ["", "a", "x" * Q.CHUNK, "y" * (Q.CHUNK + 1), "plain words, é and 日本", "long text " * 90, None]


def plainly(net, text):
    """One document's probability, place by place and filter by filter."""
    w, data = net.weights, (text or "").encode()
    step = Q.CHUNK - Q.OVERLAP
    starts = range(0, max(1, -(-(len(data) - Q.OVERLAP) // step)) * step, step)
    features = []
    for a in starts:
        chunk = [b + 1 for b in data[a : a + Q.CHUNK]]
        chunk += [0] * (Q.CHUNK - len(chunk))
        maxima = np.full(Q.FILTERS, -np.inf)
        for at in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STEP):
            x = np.concatenate([w["bytes"][b] for b in chunk[at : at + Q.WIDTH]])
            for f in range(Q.FILTERS):
                maxima[f] = max(maxima[f], float(x @ w["filters"][:, f]))
        m = np.maximum(maxima + w["filters_bias"], 0)
        features.append(np.maximum(m @ w["chunk"] + w["chunk_bias"], 0))
    both = np.concatenate([np.max(features, 0), np.mean(features, 0)])
    z = np.maximum(both @ w["mix"] + w["mix_bias"], 0) @ w["out"] + w["out_bias"]
    return 1 / (1 + np.exp(-float(z[0])))


@pytest.fixture(scope="module")
def net():
    made = Q.Network.fresh(5)
    r = np.random.default_rng(1)
    for k in made.weights:
        if k.endswith("_bias"):
            made.weights[k] += r.normal(size=made.weights[k].shape).astype(np.float32) * 0.2
    return made


def test_rows_are_scored_as_one_by_one(spark, net):
    rows = [(i, t, 0.5, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], 0.5, "x"), (1, TEXTS[1], 0.5, "x"), (50, "z" * 300_000, 0.5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, key string").repartition(3)
    got = sorted(map(tuple, Q.scored(df, net).collect()), key=repr)
    long = net.score(np.frombuffer(rows[-1][1].encode(), np.uint8), np.array([0, 300_000]))[0]
    want = sorted(((i, long if i == 50 else plainly(net, t)) for i, t, *_ in rows), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
    middle = float(np.median([w[1] for w in want]) + 1e-4)
    kept = Q.keep_good(df, net, middle)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i, s in want if s >= middle)
    assert Q.scored(df.limit(0), net).count() == 0 and Q.keep_good(df.limit(0), net).count() == 0


def test_fit_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x")], "doc_id long, text string")
    score = lambda labels: Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).score(np.zeros(0, np.uint8), np.array([0, 0]))[0]
    assert score([]) == 0.5 and score([(None, 1, 0), (1, None, 0)]) == 0.5
    free = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 5]
    assert score([(i, 1, 0) for i in free]) > 0.9 and score([(i, 0, 0) for i in free]) < 0.1
    assert score([(i, 1, 0) for i in range(len(TEXTS)) if i not in free]) == 0.5  # held out, never seen


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    seen = [(labels[r.doc_id], r.score) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    one, zero = (np.array([s for y, s in seen if y == k]) for k in (1, 0))
    area = float((one[:, None] > zero[None]).mean())
    right = float(np.mean([(s >= 0.3) == y for y, s in seen]))
    print(f"held-out rows {len(seen)}, area {area:.4f}, accuracy {right:.4f}, majority {max(len(one), len(zero)) / len(seen):.4f}")
    assert area > 0.95 and right > max(len(one), len(zero)) / len(seen) + 0.05
