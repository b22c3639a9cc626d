"""A bitmap of hashed ids, of a bounded size, that spares a join most rows.

A row whose id isn't in the bitmap surely isn't among the ids; the others are
still to be joined. The bound holds whatever the number of ids: a crowded
bitmap only passes more rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: 2 ** 26 bits are 8 MB.
MOST_BITS = 26


def mixed(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class Bitmap:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = mixed(np.ascontiguousarray(ids, np.int64)) >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(ids: DataFrame, most_bits: int = MOST_BITS) -> Bitmap:
    """A bitmap of the table's one bigint column; at most 2 ** most_bits bits."""
    (name,) = ids.columns
    n = ids.count()
    bits = max(10, min(most_bits, (16 * max(n, 1)).bit_length()))

    def places(batches):
        import pyarrow as pa

        for b in batches:
            at = mixed(np.asarray(b.column(0)).astype(np.int64)) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["w", "v"])

    rows = ids.where(F.col(name).isNotNull()).mapInArrow(lean(places), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    if rows.num_rows:
        words[np.asarray(rows["w"])] = np.asarray(rows["v"]).astype(np.int64).view(np.uint64)
    return Bitmap(words, bits)
