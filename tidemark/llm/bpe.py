"""Byte-level BPE by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
token itself is resolved by one probe. Tier two merges the bytes of the others
in a doubly linked list, with a heap of the adjacent pairs' ranks. A bounded
memory of pre-tokens met before spares both.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced

#: Pre-tokens remembered per task; beyond it the memory starts anew.
MOST_KNOWN = 500_000


class MinimalPerfectHash:
    """Hash and displace: n keys to the n slots 0..n-1 without a collision.

    Keys fall into buckets; from the largest bucket on, each takes the first
    displacement that puts its keys into free slots. Buckets of one key name
    a free slot outright (stored as -1 - slot).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        assert n and len(set(keys)) == n
        self.n, self.buckets = n, max(1, n // 3)
        self.shift = [0] * self.buckets
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups[h % self.buckets].append((h, i))
        self.slot_key: list[int] = [-1] * n
        free = set(range(n))
        for g in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            hashes = groups[g]
            if not hashes:
                break
            if len(hashes) == 1:
                at = free.pop()
                self.shift[g] = -1 - at
                self.slot_key[at] = hashes[0][1]
                continue
            d = 0
            while True:
                at = [self._at(h, d) for h, _ in hashes]
                if len(set(at)) == len(at) and free.issuperset(at):
                    break
                d += 1
            self.shift[g] = d
            for place, (_, i) in zip(at, hashes, strict=True):
                self.slot_key[place] = i
            free.difference_update(at)

    def _at(self, h: int, d: int) -> int:
        return ((h >> 20) + d * ((h >> 42) | 1) + d * d * d) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else self._at(h, d)


class Encoder:
    """The tokens of a rank file, as the tiktoken library would choose them."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.hash = MinimalPerfectHash(self.tokens)
        # Slot order, so that a probe reads one key and one id.
        self.slot_token = [self.tokens[i] for i in self.hash.slot_key]
        self.slot_id = [self.ids[i] for i in self.hash.slot_key]
        self.bytes_of: dict[int, bytes] = dict(zip(self.ids, self.tokens, strict=True))
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("the rank file lacks a single byte")
        # Two tokens' ids to the id of their concatenation, where that is a token.
        self.joined: dict[int, int] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.joined[a << 32 | b] = r
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the piece's own id, if it is a token."""
        at = self.hash.slot(piece)
        return self.slot_id[at] if self.slot_token[at] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: merge the adjacent pair of lowest rank, leftmost first, until none is a token."""
        single, joined = self.single, self.joined
        ids = [single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := joined.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := joined.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (x := joined.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        one = self.whole(data)
        return np.array([one] if one is not None else self.merged(data), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text; null is empty."""
        pieces, known = self.find(text or ""), self.known
        for p in set(pieces).difference(known):
            known[p] = self.piece(p)
        out = b"".join(map(known.__getitem__, pieces))
        if len(known) > MOST_KNOWN:
            known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the key, n_tokens, ids (array) and decoded (binary, the ids
    decoded again); with digests the two SHA-256 sums in their place.

    A null text counts as empty (no ids); null and repeated keys are encoded
    as the rows they are; an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        e = encoder(path, pattern)
        for whole in batches:
            for batch in sliced(whole):
                ids = [e.encode(t) for t in batch.column(1).to_pylist()]
                back = [e.decode(x) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (ids, back)]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    more = [pa.array([np.frombuffer(x, np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0), n, *more], ["key", "n_tokens", *names])

    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return given.mapInArrow(lean(run), f"key {kind}, n_tokens long, {schema}").withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
