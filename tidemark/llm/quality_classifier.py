"""A byte-level convolutional network in numpy that scores whole documents.

A document's UTF-8 bytes are read in overlapping chunks that cover all of it.
In each chunk learned filters run over byte embeddings and are max-pooled; a
dense layer turns a chunk's maxima into chunk features. A document's features
are the maximum and the mean over its chunks; a dense layer and a logistic
unit combine them into one probability. Training (Adam on a bounded sample of
labelled rows) is plain numpy, and so is scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, sliced, utf8

#: Bytes of a chunk, and the part of it that the next chunk repeats.
CHUNK, OVERLAP = 256, 32
#: Filter width and step in bytes; byte dimensions; filters; chunk and document features.
WIDTH, STEP, DIMS, FILTERS, FEATURES, HIDDEN = 8, 4, 8, 48, 32, 24
#: The documented bound of the training sample: rows, and bytes of their texts (fewer rows are taken, each whole).
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20
#: Chunks in one numpy step.
AT_ONCE = 512
THRESHOLD = 0.3


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; even no bytes have one (empty) chunk."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(1, -(-(n - OVERLAP) // step)), dtype=np.int64) * step


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as rows of byte + 1, 0 beyond the end; each chunk's document)."""
    starts, owner = [], []
    for i in range(len(offsets) - 1):
        s = chunk_starts(int(offsets[i + 1] - offsets[i]))
        starts.append(s + offsets[i])
        owner.append(np.full(len(s), i))
    at, owner = np.concatenate(starts), np.concatenate(owner)
    padded = np.concatenate([data.astype(np.int16) + 1, np.zeros(CHUNK, np.int16)])
    places = at[:, None] + np.arange(CHUNK)
    rows = padded[places]
    rows[places >= offsets[owner + 1][:, None]] = 0
    return rows, owner


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        shape = {"bytes": (257, DIMS), "filters": (WIDTH * DIMS, FILTERS), "chunk": (FILTERS, FEATURES), "mix": (2 * FEATURES, HIDDEN), "out": (HIDDEN, 1)}
        w = {k: (r.normal(size=s) * (0.5 if k == "bytes" else np.sqrt(2 / s[0]))).astype(np.float32) for k, s in shape.items()}
        w["bytes"][0] = 0
        for k, n in (("filters", FILTERS), ("chunk", FEATURES), ("mix", HIDDEN), ("out", 1)):
            w[f"{k}_bias"] = np.zeros(n, np.float32)
        return cls(w)

    def _maxima(self, rows: np.ndarray, keep: bool = False):
        """Each chunk's filter maxima, above zero and as they are, and their places if kept."""
        w = self.weights
        e = w["bytes"][rows].reshape(len(rows), CHUNK * DIMS)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIMS, axis=1)[:, :: STEP * DIMS]
        flat = np.ascontiguousarray(view).reshape(-1, WIDTH * DIMS)
        z = (flat @ w["filters"]).reshape(len(rows), -1, FILTERS)
        where = z.argmax(1) if keep else None
        m = z.max(1) + w["filters_bias"]
        return np.maximum(m, 0), m, where

    def features(self, rows: np.ndarray) -> np.ndarray:
        m = self._maxima(rows)[0]
        return np.maximum(m @ self.weights["chunk"] + self.weights["chunk_bias"], 0)

    def combine(self, chunk_features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        d = np.concatenate([np.maximum.reduceat(chunk_features, first), np.add.reduceat(chunk_features, first) / np.diff(np.r_[first, len(owner)])[:, None]], 1)
        h = np.maximum(d @ self.weights["mix"] + self.weights["mix_bias"], 0)
        z = (h @ self.weights["out"] + self.weights["out_bias"])[:, 0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, data: np.ndarray, offsets: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
        """Probabilities of the documents data[offsets[i]:offsets[i + 1]]."""
        if len(offsets) < 2:
            return np.zeros(0)
        rows, owner = chunked(data, offsets)
        f = np.concatenate([self.features(rows[i : i + at_once]) for i in range(0, len(rows), at_once)])
        return self.combine(f, owner, len(offsets) - 1)

    def gradients(self, rows: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        blocks = [slice(i, i + AT_ONCE) for i in range(0, len(rows), AT_ONCE)]
        relu_m, m, where = (np.concatenate(x) for x in zip(*(self._maxima(rows[b], keep=True) for b in blocks), strict=True))
        zc = relu_m @ w["chunk"] + w["chunk_bias"]
        c = np.maximum(zc, 0)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[first, len(owner)])
        top, mean = np.maximum.reduceat(c, first), np.add.reduceat(c, first) / sizes[:, None]
        d = np.concatenate([top, mean], 1)
        zh = d @ w["mix"] + w["mix_bias"]
        h = np.maximum(zh, 0)
        p = 1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"])[:, 0]))
        g: dict[str, np.ndarray] = {}
        dz = ((p - labels) * weight / weight.sum()).astype(np.float32)[:, None]
        g["out"], g["out_bias"] = h.T @ dz, dz.sum(0)
        dh = (dz @ w["out"].T) * (zh > 0)
        g["mix"], g["mix_bias"] = d.T @ dh, dh.sum(0)
        dd = dh @ w["mix"].T
        hit = c == np.repeat(top, sizes, axis=0)
        ties = np.add.reduceat(hit.astype(np.float32), first)
        dc = hit * np.repeat(dd[:, :FEATURES] / ties, sizes, axis=0) + np.repeat(dd[:, FEATURES:] / sizes[:, None], sizes, axis=0)
        dc *= zc > 0
        g["chunk"], g["chunk_bias"] = relu_m.T @ dc, dc.sum(0)
        dm = (dc @ w["chunk"].T) * (m > 0)
        g["filters_bias"] = dm.sum(0)
        # Only the winning place of each filter in each chunk has a gradient.
        g["filters"], g["bytes"] = np.zeros_like(w["filters"]), np.zeros((257, DIMS))
        for b in blocks:
            at = where[b][:, :, None] * STEP + np.arange(WIDTH)
            byte = np.take_along_axis(rows[b], at.reshape(len(at), -1), axis=1)
            won = w["bytes"][byte].reshape(len(at), FILTERS, WIDTH * DIMS)
            g["filters"] += np.einsum("nfk,nf->kf", won, dm[b], optimize=True)
            flat_de = (dm[b][:, :, None] * w["filters"].T[None]).reshape(-1, DIMS)
            g["bytes"] += np.stack([np.bincount(byte.ravel(), flat_de[:, k], minlength=257) for k in range(DIMS)], 1)
        g["bytes"] = g["bytes"].astype(np.float32)
        g["bytes"][0] = 0
        return g


def train(texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 4e-3, seed: int = 7) -> Network:
    """A network fitted to documents and their 0/1 labels; without both labels
    it is a constant: the share of label 1."""
    net = Network.fresh(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.weights["out"][:] = 0
        net.weights["out_bias"][:] = 4.0 if len(labels) and labels[0] == 1 else (-4.0 if len(labels) else 0.0)
        return net
    r = np.random.default_rng(seed)
    one, zero = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        # As many of the rarer label; its weight undoes that, so scores stay probabilities.
        chosen = np.concatenate([r.choice(one, batch // 2), r.choice(zero, batch // 2)])
        share = np.where(labels[chosen] == 1, len(one), len(zero)).astype(np.float32)
        share = np.sqrt(share / len(labels))
        # All chunks of a text, as in scoring.
        some = [texts[i] for i in chosen]
        rows, owner = chunked(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        g = net.gradients(rows, owner, labels[chosen], share)
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, v in net.weights.items():
            a, b = moments[k]
            a += 0.1 * (g[k] - a)
            b += 0.01 * (g[k] ** 2 - b)
            v -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Fits on at most ``rows`` labelled rows that aren't held out: those whose
    hashed id is smallest, so the sample is the same whatever the layout. Where
    their texts have more than SAMPLE_BYTES, fewer rows are taken in that order.
    Only text and label are seen, the text whole.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~F.coalesce(held_out("doc_id"), F.lit(False))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # rows bounds the broadcast

    sample = found.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"))
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in sample.select("h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect())
    fits = int((np.cumsum([n for _, _, n in sizes]) <= SAMPLE_BYTES).sum())
    if fits < len(sizes):
        # Up to the first row that doesn't fit; one row at least.
        h, doc_id, _ = sizes[max(fits, 1) - 1]
        sample = sample.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("doc_id") <= F.lit(doc_id))))
    got = sorted(([r["doc_id"], bytes(r["text"] or b""), r["quality"]] for r in sample.collect()), key=lambda r: r[:2])
    return train([r[1] for r in got], np.array([r[2] for r in got]))


def scored(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and score (0 to 1). A null text counts as empty and has
    the score of no bytes; repeated rows and null keys are scored as they are;
    an empty table gives an empty table."""
    weights = net.weights
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = Network(weights)
        for whole in batches:
            for batch in sliced(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(*utf8(batch)))], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with docs' own
    columns; each row is judged where it is read, so nothing is shuffled."""
    weights = net.weights

    def run(batches):
        own = Network(weights)
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in sliced(whole):
                good = own.score(*utf8(pa.RecordBatch.from_arrays([batch.column(at)], ["text"]))) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, net).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
