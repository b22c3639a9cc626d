"""Suffix-array dedup: bytes of passages that an earlier document has, too.

A byte goes if some LENGTH-byte string that covers it also starts in a
document of a smaller id. Equal strings are brought together by sorting
suffixes deep-shallow (multikey quicksort on eight-byte characters to a
shallow depth, then a blind trie for every group whose prefix is still
common), but only those that can have a copy elsewhere:

1.  Every window of LENGTH bytes has an anchor, the K-gram of least hash in
    it; equal windows have equal anchors at equal places. Windows in a row
    with the same anchor are a run. Chunks of documents send each anchor hash
    once, and get back one bit: does another chunk have it, too?
2.  Runs whose anchor has a copy are fragments. A chunk sends each different
    fragment once, with its smallest document. Of fragments that are equal
    byte for byte one is taken; the windows of all others are sorted, and
    windows equal over LENGTH bytes get their smallest document.
3.  Chunks mark the windows that have a smaller document elsewhere, take the
    union of their bytes, and cut them out of the whole texts.

All that is shuffled grows with the input, not with the square of a group of
copies: a passage in a third of all documents is one fragment per chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap_of
from .common import lean, lean_cogroup, lean_group, parts, pinned, sliced, utf8

LENGTH, K = 50, 24
W = LENGTH - K + 1
#: Text of a chunk; positions handled by one vector step; anchors in a bucket.
CHUNK_BYTES, BLOCK, BUCKET = 2 << 20, 1 << 18, 1 << 20
#: Text whose fragments one task of a shuffle handles.
PART_BYTES = 16 << 20
#: Depth to which multikey quicksort orders suffixes before the tries take over.
SHALLOW = 24
NO_DOC = (1 << 63) - 1

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_B = np.uint64(0xA0761D6478BD642F)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_B, BLOCK + W), _powers(_B_INVERSE, BLOCK + W)


def _eights(data: np.ndarray) -> np.ndarray:
    """The little-endian number in the eight bytes from every place on."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for j in range(8):
        m = (n - j + 7) // 8
        if m > 0:
            out[j::8] = data[j : j + 8 * m].view("<u8")
    return out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K = 24 bytes from every place on."""
    e = _eights(data)
    n = len(e) - 16
    h = e[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h += e[8 : n + 8]
    h *= _C[1]
    h ^= h >> np.uint64(31)
    h += e[16 : n + 16]
    h *= _C[2]
    h ^= h >> np.uint64(30)
    h *= _C[3]
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor hash, fragment hash) of all runs."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
    lengths = np.diff(offsets)
    out: list[tuple] = []
    with np.errstate(over="ignore"):
        for b in range(0, n, BLOCK):
            m = min(BLOCK, n - b)
            h = _gram_hashes(padded[b : b + m + LENGTH])[: m + W - 1]
            c = h & ~np.uint64((1 << 19) - 1) | np.arange(m + W - 1, dtype=np.uint64)
            for d in (1, 2, 4, 8):
                c = np.minimum(c[:-d], c[d:])
            c = np.minimum(c[:m], c[W - 16 : W - 16 + m])
            anchor = (c & np.uint64((1 << 19) - 1)).astype(np.int64)
            first, last = np.searchsorted(offsets, [b, b + m - 1], side="right") - 1
            ends = np.repeat(offsets[first + 1 : last + 2], np.diff(np.r_[b, offsets[first + 1 : last + 1], b + m]))
            valid = np.flatnonzero(np.arange(b, b + m) + LENGTH <= ends)
            if not len(valid):
                continue
            a = anchor[valid]
            new = np.r_[True, (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)]
            at = np.flatnonzero(new)
            start, count = valid[at], np.diff(np.r_[at, len(valid)])
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * _UP[: len(h)], out=total[1:])
            whole = (total[start + count + W - 1] - total[start]) * _DOWN[start] + count.astype(np.uint64) * _C[1]
            whole ^= whole >> np.uint64(32)
            out.append((start + b, count, h[a[at]], whole * _C[0]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    start, count, hashes, whole = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.repeat(np.arange(len(lengths)), lengths)[start] if len(lengths) else start, start, count, hashes, whole


class BlindTrie:
    """Orders strings that share a prefix: inner nodes know a depth and branch
    on the byte there; only a string's leaf is compared with it in full."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, None

    def insert(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = (text, [item])
            return
        node, way = self.root, []
        while isinstance(node, list):
            way.append(node)
            # Blind: a byte without a child goes on anywhere; the comparison will tell.
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        leaf = node[0]
        if leaf == text:
            node[1].append(item)
            return
        at = next(i for i in range(self.depth) if leaf[i] != text[i])
        above, below = None, self.root
        for n in way:
            if n[0] >= at:
                break
            above, below = n, n[1].get(text[n[0]])
        if isinstance(below, list) and below[0] == at:
            below[1][text[at]] = (text, [item])
            return
        fork = [at, {leaf[at]: below, text[at]: (text, [item])}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def groups(self) -> list[list[int]]:
        """Items of equal strings, in the strings' order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by their first depth bytes, group number of each
    place in that order; suffixes equal over depth bytes are one group)."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    big = _eights(padded).byteswap(inplace=True)
    starts = starts.astype(np.int32)
    key = big[starts]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(order) else np.zeros(0, bool)
    for d in range(8, SHALLOW, 8):
        # The groups of several suffixes, one character deeper.
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        live = np.flatnonzero((np.bincount(group) > 1)[group]) if len(order) else []
        if not len(live):
            break
        some, g = order[live], group[live]
        key = big[starts[some] + d]
        by = np.lexsort((key, g))
        order[live] = some[by]
        key, g = key[by], g[by]
        new[live] = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
    bounds = np.flatnonzero(np.r_[new, True])
    for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist(), strict=True):
        trie = BlindTrie(depth - SHALLOW)
        for item in order[a:b].tolist():
            s = int(starts[item]) + SHALLOW
            trie.insert(padded[s : s + depth - SHALLOW].tobytes(), item)
        at = a
        for items in trie.groups():
            order[at : at + len(items)] = items
            new[at] = True
            at += len(items)
    return order, np.cumsum(new, dtype=np.int32) - np.int32(1)


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        base, made = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        texts: list[bytes] = []
        size = 0

        def closed():
            offsets = np.cumsum([0, *map(len, texts)])
            columns = [[base + made], [np.array([NO_DOC if k is None else k for k in keys], np.int64).tobytes()], [offsets.astype(np.int64).tobytes()], [pack.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["chunk", "docs", "offsets", "text"])

        for whole in batches:
            for batch in sliced(whole, most=CHUNK_BYTES // 2):
                data, offsets = utf8(batch)
                keys += batch.column(0).to_pylist()
                texts += [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield closed()
                    made, keys, texts, size = made + 1, [], [], 0
        if keys:
            yield closed()

    return docs.mapInArrow(lean(run), "chunk long, docs binary, offsets binary, text binary")


def _opened(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    row = table.slice(0, 1).to_pylist()[0]
    offsets = np.frombuffer(row["offsets"], np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, int(offsets[-1]))), np.uint8)
    return row["chunk"], np.frombuffer(row["docs"], np.int64), offsets, data


def _by_bucket(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and hash, each bucket's bounds in it)."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(n)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))


def _low(hashes: np.ndarray) -> bytes:
    """Half of each hash; the bucket stands for more. A false match (one in
    thousands, as a bucket has a bounded number) only lets a run go to step 2."""
    return hashes.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _anchors(chunks: DataFrame, n: int) -> DataFrame:
    """(bucket, chunk, hashes) of each chunk's different anchors."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, _, offsets, data = _opened(pa.Table.from_batches([batch.slice(i, 1)]))
                hashes = np.unique(runs(data, offsets)[3])
                order, bounds = _by_bucket(hashes, n)
                filled = np.flatnonzero(np.diff(bounds))
                blobs = [_low(hashes[order[bounds[b] : bounds[b + 1]]]) for b in filled]
                yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(np.full(len(filled), chunk)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "hashes"])

    return chunks.mapInArrow(lean(run), "bucket int, chunk long, hashes binary")


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk's hashes in order, a bit: another chunk has it."""
    rows = [_wide(x) for x in table["hashes"].to_pylist()]
    flat = np.concatenate(rows)
    order = np.argsort(flat, kind="stable")
    h = flat[order]
    same = np.r_[False, h[1:] == h[:-1]]
    hit = np.zeros(len(flat), bool)
    hit[order] = same | np.r_[same[1:], False]
    bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(r) for r in rows])[:-1])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


#: Of the anchor half its hash: anchors that agree in it are sorted together, no more.
_FRAGMENT = np.dtype([("anchor", "<u4"), ("whole", "<u8"), ("least", "<i8"), ("most", "<i8"), ("count", "<u1")])


def _packed(heads: np.ndarray, texts: np.ndarray) -> bytes:
    """Field by field, compressed: hashes stay as they are, ids and text shrink."""
    import zstandard

    fields = b"".join(np.ascontiguousarray(heads[k] if k != "most" else heads["most"] - heads["least"]).tobytes() for k in _FRAGMENT.names)
    return len(heads).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(fields + texts.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, raw = int.from_bytes(data[:4], "little"), zstandard.ZstdDecompressor().decompress(data[4:])
    heads, at = np.zeros(n, _FRAGMENT), 0
    for k in _FRAGMENT.names:
        heads[k] = np.frombuffer(raw, _FRAGMENT[k], n, at)
        at += n * _FRAGMENT[k].itemsize
    heads["most"] += heads["least"]
    return heads, np.frombuffer(raw, np.uint8, offset=at)


def _fragments(n: int):
    """Cogroup function: a chunk and its bits to (bucket, chunk, fragments)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "fragments": pa.array([], pa.binary())})
        if not left.num_rows:
            return empty
        chunk, docs, offsets, data = _opened(left)
        doc, start, count, hashes, whole = runs(data, offsets)
        if not len(doc):
            return empty
        different, back = np.unique(hashes, return_inverse=True)
        order, bounds = _by_bucket(different, n)
        flag = np.zeros(len(different), bool)
        for r in right.to_pylist():
            places = order[bounds[r["bucket"]] : bounds[r["bucket"] + 1]]
            flag[places] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(places)).astype(bool)
        ids = docs[doc]
        # Or two documents of this chunk have it.
        low, high = np.full(len(different), NO_DOC), np.full(len(different), -(1 << 63))
        np.minimum.at(low, back, ids)
        np.maximum.at(high, back, ids)
        take = np.flatnonzero((flag | (low < high))[back])
        if not len(take):
            return empty
        _, one, back = np.unique(whole[take], return_index=True, return_inverse=True)
        heads = np.zeros(len(one), _FRAGMENT)
        anchor = hashes[take][one]
        heads["anchor"], heads["whole"], heads["count"] = (anchor >> np.uint64(8)).astype(np.uint32), whole[take][one], count[take][one]
        heads["least"], heads["most"] = NO_DOC, -(1 << 63)
        least, most = heads["least"].copy(), heads["most"].copy()
        np.minimum.at(least, back, ids[take])
        np.maximum.at(most, back, ids[take])
        heads["least"], heads["most"] = least, most
        begin = start[take][one]
        order, bounds = _by_bucket(anchor, n)
        filled = np.flatnonzero(np.diff(bounds))
        heads, begin = heads[order], begin[order]
        sizes = heads["count"].astype(np.int64) + LENGTH - 1
        places = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        texts, ends = data[places], np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({
            "bucket": pa.array(filled.astype(np.int32)),
            "chunk": pa.array(np.full(len(filled), chunk)),
            "fragments": pa.array([_packed(heads[bounds[b] : bounds[b + 1]], texts[ends[bounds[b]] : ends[bounds[b + 1]]]) for b in filled], pa.binary()),
        })

    return run


#: Fragments whose bytes are compared in one vector step.
COMPARED = 1 << 14


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … of each run of so many, end to end."""
    ends = np.cumsum(sizes)
    out = np.repeat(begin - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def least_documents(heads: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each fragment's windows begin in the result, the smallest document
    of every window), over fragments and their texts end to end."""
    counts = heads["count"].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    if not len(heads):
        return first, np.zeros(0, np.int64)
    begin = np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)
    # Equal fragments: one each from here on.
    order = np.lexsort((heads["whole"], heads["anchor"]))
    h = heads[order]
    new = np.r_[True, (h["anchor"][1:] != h["anchor"][:-1]) | (h["whole"][1:] != h["whole"][:-1]) | (h["count"][1:] != h["count"][:-1])]
    # Hashes say that they are equal, bytes decide; those that differ are sorted apart.
    like = np.flatnonzero(~new)
    for i in range(0, len(like), COMPARED):
        some = like[i : i + COMPARED]
        sizes = counts[order[some]] + LENGTH - 1
        a, b = (texts[_places(begin[order[x]], sizes)] for x in (some, some - 1))
        unlike = a != b
        if unlike.any():
            new[some[np.unique(np.repeat(np.arange(len(some)), sizes)[unlike])]] = True
    kind = np.empty(len(heads), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[np.flatnonzero(new)]
    least = np.minimum.reduceat(h["least"], np.flatnonzero(new))
    n = counts[one]
    at = np.concatenate([[0], np.cumsum(n)])
    found = np.repeat(least, n)
    # Of the text, too, only that of different fragments.
    sizes = n + LENGTH - 1
    texts = texts[_places(begin[one], sizes)]
    order, group = deep_shallow(texts, _places(np.cumsum(sizes) - sizes, n))
    lows = np.minimum.reduceat(found[order], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
    found[order] = lows[group]
    places = np.repeat(at[kind], counts) + np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return first, found[places]


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk, the fragments some of whose windows a smaller document has."""
    blobs = [_unpacked(x) for x in table["fragments"].to_pylist()]
    heads = np.concatenate([h for h, _ in blobs])
    first, least = least_documents(heads, np.concatenate([t for _, t in blobs]))
    counts = np.diff(first)
    useful = np.minimum.reduceat(least, first[:-1]) < heads["most"]
    bounds = np.cumsum([0, *(len(h) for h, _ in blobs)])
    whole, documents = [], []
    for i in range(len(blobs)):
        mine = np.flatnonzero(useful[bounds[i] : bounds[i + 1]]) + bounds[i]
        whole.append(np.rec.fromarrays([heads["whole"][mine], counts[mine].astype(np.uint8)], dtype=_ANSWER).tobytes())
        places = np.repeat(first[mine] - (np.cumsum(counts[mine]) - counts[mine]), counts[mine]) + np.arange(counts[mine].sum())
        values = least[places]
        # Mostly one document for many windows in a row: runs of equal values.
        at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        documents.append(np.rec.fromarrays([values[at], np.diff(np.r_[at, len(values)])], dtype=_VALUE).tobytes())
    out = pa.table({"chunk": table["chunk"], "heads": pa.array(whole, pa.binary()), "least": pa.array(documents, pa.binary())})
    return out.filter(pa.array([bool(x) for x in whole]))


_ANSWER = np.dtype([("whole", "<u8"), ("count", "<u1")])
_VALUE = np.dtype([("doc", "<i8"), ("n", "<u4")])


def removed_mask(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, answers: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Which bytes go, by the answers to a chunk's fragments."""
    doc, start, count, _, whole = runs(data, offsets)
    marks = np.zeros(len(data) + 1, np.int64)
    heads = np.concatenate([np.frombuffer(h, _ANSWER) for h, _ in answers]) if answers else np.zeros(0, _ANSWER)
    if len(heads) and len(doc):
        values = [np.frombuffer(v, _VALUE) for _, v in answers]
        least = np.concatenate([np.repeat(v["doc"], v["n"]) for v in values])
        n = heads["count"].astype(np.int64)
        begin = np.cumsum(n) - n
        order = np.argsort(heads["whole"])
        at = np.minimum(np.searchsorted(heads["whole"][order], whole), len(heads) - 1)
        hit = np.flatnonzero(heads["whole"][order][at] == whole)
        which, c = order[at[hit]], count[hit]
        inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        earlier = least[np.repeat(begin[which], c) + inner] < np.repeat(docs[doc[hit]], c)
        windows = (np.repeat(start[hit], c) + inner)[earlier]
        np.add.at(marks, windows, 1)
        np.add.at(marks, windows + LENGTH, -1)
    return np.cumsum(marks[:-1]) > 0


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_spans: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            _, docs, offsets, data = _opened(left)
            gone = removed_mask(data, offsets, docs, list(zip(right["heads"].to_pylist(), right["least"].to_pylist(), strict=True)))
            for k, a, b in zip(docs.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                g, text = gone[a:b], data[a:b]
                n = int(g.sum())
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
                if with_spans:
                    edges = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)) if n else []
                    rows.append((None if k == NO_DOC else k, b - a, n, spans, hashlib.sha256(text.tobytes()).hexdigest(), np.asarray(edges, np.int64).tobytes()))
                else:
                    kept = text[~g].tobytes() if n else text.tobytes()
                    rows.append((None if k == NO_DOC else k, b - a, n, spans, hashlib.sha256(kept).hexdigest()))
        types = [*[pa.int64()] * 4, pa.string(), *[pa.binary()] * with_spans]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["text_sha256", "spans"] if with_spans else ["kept_sha256"])]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def dedup(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, and kept_sha256 or (with_spans)
    text_sha256, of the text as it was, and spans: the removed runs' starts and
    ends in bytes, as 64-bit numbers in turn.

    A null text counts as empty; texts shorter than LENGTH bytes lose nothing;
    a null id counts as larger than all others; rows with one id are one
    document for the order, so they leave each other alone, and each is
    returned. Other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = pinned(_chunks(docs))
    n_chunks = chunks.count()
    # Widths grow with the text, so what a task reads doesn't; twice as many parts as buckets, as a part may get several.
    n = max(1, -(-n_chunks * CHUNK_BYTES // (8 * BUCKET)))
    width, wide = max(parts(spark), n_chunks * CHUNK_BYTES // PART_BYTES), max(parts(spark), 2 * n)
    bits = _anchors(chunks, n).repartition(wide, "bucket").groupBy("bucket").applyInArrow(lean_group(_shared), "chunk long, bucket int, bits binary")
    placed = chunks.repartition(width, "chunk")
    fragments = placed.groupBy("chunk").cogroup(bits.repartition(width, "chunk").groupBy("chunk")).applyInArrow(lean_cogroup(_fragments(n)), "bucket int, chunk long, fragments binary")
    answers = fragments.repartition(wide, "bucket").groupBy("bucket").applyInArrow(lean_group(_answers), "chunk long, heads binary, least binary")
    schema = SCHEMA.replace("kept_sha256 string", "text_sha256 string, spans binary") if with_spans else SCHEMA
    return placed.groupBy("chunk").cogroup(answers.repartition(width, "chunk").groupBy("chunk")).applyInArrow(lean_cogroup(_cut(with_spans)), schema)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text, n_chars counted anew, and
    the other columns as they were; a character that a cut splits goes whole.
    A row whose text loses nothing keeps it, null included. A bounded bitmap
    of the ids that lose something lets the other rows pass unshuffled.
    """
    cut = dedup(docs, with_spans=True).where("n_removed > 0").select(F.col("doc_id").alias("__s_id"), F.col("text_sha256").alias("__s_sha"), F.col("spans").alias("__s_spans"))
    cut = pinned(cut)
    known = bitmap_of(cut.select("__s_id"))

    @F.pandas_udf("boolean")
    def maybe(i):
        return pd.Series(known.has(i.fillna(0).to_numpy(np.int64))) | i.isna()

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is not None:
                data = t.encode()
                edges = [0, *np.frombuffer(s, np.int64).tolist(), len(data)]
                t = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    tested = docs.select("*", maybe(F.col("doc_id").cast("long")).alias("__s_maybe"))
    # Rows of one id and one text lose the same bytes.
    new = cut.groupBy("__s_id", "__s_sha").agg(F.first("__s_spans").alias("__s_spans"))
    asked = tested.where("__s_maybe").join(new, F.col("doc_id").eqNullSafe(F.col("__s_id")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("__s_sha")), "left")
    hit = F.col("__s_sha").isNotNull()
    asked = asked.withColumn("text", without("text", "__s_spans"))
    if "n_chars" in docs.columns:
        asked = asked.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return tested.where("not __s_maybe").select(*docs.columns).union(asked.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup(table(spark, sf_dir, "documents"))
