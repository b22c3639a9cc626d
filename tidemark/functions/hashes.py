"""Bob Jenkins' public-domain string hashes, vectorised: lookup2 and lookup3 as
signed 32-bit numbers, for shard functions that must agree with a database's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = np.uint32(0xFFFFFFFF)


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint32(k)) | (x >> np.uint32(32 - k))


# The shift and rotation schedules of the two published mixers.
_MIX2 = ((13, ">"), (8, "<"), (13, ">"), (12, ">"), (16, "<"), (5, ">"), (3, ">"), (10, "<"), (15, ">"))
_MIX3 = (4, 6, 8, 16, 19, 4)
_FINAL3 = (14, 11, 25, 16, 4, 14, 24)


def _mix2(v: list[np.ndarray]) -> None:
    for i, (k, way) in enumerate(_MIX2):
        x, y, z = i % 3, (i + 1) % 3, (i + 2) % 3
        v[x] = v[x] - v[y] - v[z]
        v[x] = v[x] ^ (v[z] >> np.uint32(k) if way == ">" else v[z] << np.uint32(k))


def _mix3(v: list[np.ndarray]) -> None:
    for i, k in enumerate(_MIX3):
        x, y, z = i % 3, (i + 2) % 3, (i + 1) % 3
        v[x] = (v[x] - v[y]) ^ _rot(v[y], k)
        v[y] = v[y] + v[z]


def _final3(v: list[np.ndarray]) -> None:
    for i, k in enumerate(_FINAL3):
        x, y = (2 + i) % 3, (1 + i) % 3
        v[x] = (v[x] ^ v[y]) - _rot(v[y], k)


def _groups(values: list[bytes]):
    by: dict[int, list[int]] = {}
    for i, b in enumerate(values):
        by.setdefault(len(b), []).append(i)
    for n, ids in by.items():
        yield n, np.array(ids), np.frombuffer(b"".join(values[i] for i in ids), np.uint8).reshape(len(ids), n)


def _words(block: np.ndarray) -> list[np.ndarray]:
    padded = np.zeros((len(block), 12), np.uint8)
    padded[:, : block.shape[1]] = block
    w = padded.view("<u4")
    return [w[:, 0].copy(), w[:, 1].copy(), w[:, 2].copy()]


def lookup2(values: list[bytes], seed: int = 3923095) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    with np.errstate(over="ignore"):
        for n, ids, data in _groups(values):
            golden = np.full(len(ids), 0x9E3779B9, np.uint32)
            v = [golden, golden.copy(), np.full(len(ids), seed, np.uint32)]
            whole = n // 12 * 12
            for at in range(0, whole, 12):
                v = [x + y for x, y in zip(v, _words(data[:, at : at + 12]), strict=True)]
                _mix2(v)
            # The third word's lowest byte is kept for the length.
            a, b, c = _words(data[:, whole:])
            v = [v[0] + a, v[1] + b, v[2] + (c << np.uint32(8)) + np.uint32(n)]
            _mix2(v)
            out[ids] = v[2]
    return out.view(np.int32)


def lookup3(values: list[bytes], seed: int = 3923095) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    with np.errstate(over="ignore"):
        for n, ids, data in _groups(values):
            start = np.full(len(ids), (0x9E3779B9 + n + seed) & 0xFFFFFFFF, np.uint32)
            v = [start, start.copy(), start.copy()]
            whole = n // 12 * 12
            for at in range(0, whole, 12):
                v = [x + y for x, y in zip(v, _words(data[:, at : at + 12]), strict=True)]
                _mix3(v)
            # The third word's lowest byte is kept free, as in the older hash.
            a, b, c = _words(data[:, whole:])
            v = [v[0] + a, v[1] + b, v[2] + (c << np.uint32(8))]
            _final3(v)
            out[ids] = v[2]
    return out.view(np.int32)


def _column(hashed, c: Column) -> Column:
    @F.pandas_udf("int")
    def run(text: pd.Series) -> pd.Series:
        good = text.notna()
        out = pd.Series([None] * len(text), dtype="Int32")
        if good.any():
            out[good.to_numpy()] = hashed([t.encode() for t in text[good]])
        return out

    return run(c)


def hashtext_old(c: Column) -> Column:
    """Signed 32-bit lookup2 hash of a text; null stays null."""
    return _column(lookup2, c)


def hashtext_new(c: Column) -> Column:
    """Signed 32-bit lookup3 hash of a text; null stays null."""
    return _column(lookup3, c)
