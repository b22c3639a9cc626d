"""Hierarchical multi-length packing of token ids into training sequences.

Within a block of documents: whole windows of the longest context are cut off
each document first; what remains is routed to a tier by its size. Pieces of
the longest tier open long windows, whose gaps are filled with whole pieces of
the shorter tiers (largest that fits), the last of them cut to fit. What is
left of the shorter tiers fills windows of its own tier. A block's last tokens
form sequences of powers of two, so nothing is padded. The sequences of each
tier are then dealt to step groups of equal load.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced

TIERS = (2048, 1024, 512, 256)
#: Tokens held by a task before it packs them.
BLOCK_TOKENS = 2_000_000
#: Tokens of one optimiser step at most, but for a block's short closing sequences.
STEP_TOKENS = 16 * 2048
END = 1

Piece = tuple[int, int, int]  # document in the block, start, length


class Packer:
    """Packs one block of document lengths; pieces are (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        assert all(a == 2 * b for a, b in zip(tiers, tiers[1:], strict=False)) and tiers[-1] & (tiers[-1] - 1) == 0
        self.tiers = tiers

    def pack(self, lengths: list[int]) -> list[tuple[int, list[Piece]]]:
        """(sequence length, pieces in order) of all sequences, each filled."""
        top = self.tiers[0]
        out: list[tuple[int, list[Piece]]] = []
        tiers: list[list[Piece]] = [[] for _ in self.tiers]
        for doc, n in enumerate(lengths):
            whole = n // top
            out.extend((top, [(doc, i * top, top)]) for i in range(whole))
            if n % top:
                tiers[self._tier(n % top)].append((doc, whole * top, n % top))
        # The shorter tiers as one list by size: the largest piece that fits a gap is found by bisection.
        short = sorted(((p[2], p[0], p[1]) for t in tiers[1:] for p in t))
        for long in sorted(tiers[0], key=lambda p: (-p[2], p[0])):
            window, gap = [long], top - long[2]
            while gap and short:
                at = bisect.bisect_right(short, (gap, 1 << 62, 0)) - 1
                n, doc, start = short.pop(at) if at >= 0 else short.pop(0)
                if n > gap:
                    bisect.insort(short, (n - gap, doc, start + gap))
                    n = gap
                window.append((doc, start, n))
                gap -= n
            out += self._closed(window) if gap else [(top, window)]
        rest: list[Piece] = []
        for size, below in zip(self.tiers[1:], (*self.tiers[2:], 0), strict=True):
            pieces = [(d, s, n) for n, d, s in short if below < n <= size]
            windows, tail = self._filled(rest + pieces, size)
            out += [(size, w) for w in windows]
            rest = tail
        return out + self._closed(rest)

    def steps(self, sequences: list[tuple[int, list[Piece]]], tokens: int = STEP_TOKENS) -> tuple[list[int], int]:
        """(each sequence's step, number of steps). A step holds sequences of one
        tier; a tier has as few steps as its tokens need, and the heaviest
        sequence left (load: the sum of its pieces' squared lengths, as attention
        costs) goes to the lightest step with room. Closing sequences shorter
        than the last tier go to that tier's steps.
        """
        out, made = [0] * len(sequences), 0
        by_tier: dict[int, list[tuple[int, int]]] = {}
        for i, (length, pieces) in enumerate(sequences):
            by_tier.setdefault(max(length, self.tiers[-1]), []).append((sum(n * n for _, _, n in pieces), i))
        for some in by_tier.values():
            n = max(1, sum(sequences[i][0] for _, i in some) // tokens)
            room = -(-sum(sequences[i][0] for _, i in some) // n)
            heap = [(0, j, 0) for j in range(made, made + n)]
            full = []
            for load, i in sorted(some, key=lambda x: (-x[0], x[1])):
                while heap and heap[0][2] + sequences[i][0] > max(room, sequences[i][0]):
                    full.append(heapq.heappop(heap))
                heap, full = (heap, full) if heap else (sorted(full), [])
                was, j, held = heapq.heappop(heap)
                out[i] = j
                heapq.heappush(heap, (was + load, j, held + sequences[i][0]))
            made += n
        return out, made

    def _tier(self, n: int) -> int:
        return max(i for i, size in enumerate(self.tiers) if n <= size)

    @staticmethod
    def _filled(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[Piece]]:
        windows, now, room = [], [], size
        for doc, start, n in pieces:
            while n:
                take = min(n, room)
                now.append((doc, start, take))
                start, n, room = start + take, n - take, room - take
                if not room:
                    windows.append(now)
                    now, room = [], size
        return windows, now

    def _closed(self, pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
        """Pieces as sequences of falling powers of two."""
        out, total = [], sum(p[2] for p in pieces)
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            windows, pieces = self._filled(pieces, size)
            out.append((size, windows[0]))
            pieces = [p for w in windows[1:] for p in w] + pieces
            total -= size
        return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece: the key, the piece's start and length among its
    document's ids (the end id last), its checksum, its sequence and offset
    there, the sequence's length (tier) and optimiser step, and with_ids the
    ids themselves.

    Each task packs what it reads, so nothing is shuffled and no task needs
    another's documents; a task leaves at most a few short sequences per
    block. Sequence and step ids begin with the task's number: the same input
    files give the same ids. A null or empty text is one end id; null and
    repeated keys are packed as the rows they are; an empty table gives an
    empty table.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenization import words_of

        words, packer = words_of(vocabulary), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        sequences = steps = 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, steps
            rows: list[tuple] = []
            blobs = []
            packed = packer.pack([len(x) for x in held])
            dealt, more = packer.steps(packed)
            for (length, pieces), step in zip(packed, dealt, strict=True):
                offset, step = 0, base + steps + step
                for doc, start, n in pieces:
                    part = held[doc][start : start + n].astype("<u4")
                    rows.append((keys[doc], start, n, zlib.crc32(part), len(held[doc]), base + sequences, offset, length, step))
                    if with_ids:
                        blobs.append(part.view(np.int32))
                    offset += n
                sequences += 1
            steps += more
            types = [key_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if with_ids:
                columns.append(pa.array(blobs, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["key", *(x.split()[0] for x in SCHEMA.split(", ")), *["ids"] * with_ids]
        for whole in batches:
            key_type = whole.schema.field("key").type
            for batch in sliced(whole):
                keys += batch.column(0).to_pylist()
                found = [np.frombuffer(x + b"\x01\x00", np.uint16) for x in words.encode(batch.column(1).to_pylist())]
                held += found
                size += sum(map(len, found))
                if size >= BLOCK_TOKENS:
                    yield flush()
                    keys, held, size = [], [], 0
        if held:
            yield flush()

    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(lean(run), f"key {kind}, {SCHEMA}" + ", ids array<int>" * with_ids).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
