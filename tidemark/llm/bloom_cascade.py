"""URL filters by a Bloom filter cascade.

Level 0 holds the listed keys. Each further level holds the keys that the
level before passes wrongly: over the corpus's own key universe level 1 has
the false positives of level 0, level 2 the listed keys that level 1 passes,
and so on, until a level passes nothing wrongly. Asking the levels in turn
then tells membership exactly for every key of that universe, without joining
the pages with the list.

Levels are built where the keys are and sent to every executor, so each has a
size bound; where a level would be larger, the keys are dealt to groups, each
with a cascade of its own, which are asked one after another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, pinned

#: Bytes of one level at most: it is collected and sent to every executor.
MOST_BYTES = 16 << 20
#: The false-positive rate that a level is made for, and its bits per key.
RATE = 0.01
KEY_BITS = -math.log(RATE) / math.log(2) ** 2


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Bloom:
    words: np.ndarray  # uint64
    size: int
    hashes: int
    seed: int

    @classmethod
    def empty(cls, n: int, seed: int, rate: float = RATE) -> Bloom:
        """For n keys, without any as yet."""
        size = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        return cls(np.zeros(-(-size // 64), np.uint64), size, max(1, round(-math.log2(rate))), seed)

    @classmethod
    def over(cls, keys: DataFrame, n: int, seed: int) -> Bloom:
        """Of a table's column k of n bigints: its tasks make the words, which are or-ed."""
        made = cls.empty(n, seed)

        def bits(batches):
            for batch in batches:
                words, values = made.parts(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], ["w", "v"])

        got = keys.select("k").mapInArrow(lean(bits), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        if got.num_rows:
            made.words[np.asarray(got["w"])] = np.asarray(got["v"]).astype(np.int64).view(np.uint64)
        return made

    def parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, the bits that the keys set there)."""
        at = np.unique(np.concatenate([np.zeros(0, np.uint64), *self._places(keys)]))
        word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
        return word[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit

    def _places(self, keys: np.ndarray):
        for i in range(self.hashes):
            yield _mix(keys, self.seed * 64 + i) % np.uint64(self.size)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Listed or not, exact for all keys of the universe it was built over."""
        live, out = np.arange(len(keys)), np.zeros(len(keys), bool)
        for depth, level in enumerate(self.levels):
            live = live[level.has(keys[live])] if len(live) else live
            # A key that passes level d is a member if d is even, until a later level says otherwise.
            out[live] = depth % 2 == 0
        return out


class Crowded(Exception):
    """A level would be larger than its bound."""


class Collision(Exception):
    """A key of the universe has the hash of a listed key that it is not."""


def build(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES, most_levels: int = 40) -> Cascade:
    """A cascade over keys (key, k): the key and its 64-bit hash.

    Null keys and repeats add nothing. An empty list gives a cascade without
    levels, which has no key. Each level's keys are counted first; one of over
    most_bytes is :class:`Crowded`. Keys themselves are compared once, between
    the list and what level 0 passes of the universe, so that a shared hash
    is a :class:`Collision` and never a wrong answer.
    """
    listed = pinned(listed.where("key is not null").dropDuplicates(["key"]).select("key", "k"))
    levels: list[Bloom] = []
    keys, rest = listed, universe.where("key is not null")
    for depth in range(most_levels):
        n = keys.count()
        if not n:
            break
        if n * KEY_BITS / 8 > most_bytes:
            raise Crowded
        levels.append(Bloom.over(keys, n, depth))
        # The other side's keys that this level passes wrongly are the next level's.
        wrong = rest.where(_tester(levels[-1])("k"))
        wrong = pinned(wrong if depth else wrong.join(listed.select("key"), "key", "left_anti").dropDuplicates(["key"]))
        if depth == 0 and wrong.join(listed.select("k"), "k", "left_semi").limit(1).count():
            raise Collision
        keys, rest = wrong.select("key", "k"), keys
    else:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def _tester(bloom: Bloom):
    @F.pandas_udf("boolean")
    def passes(k: pd.Series) -> pd.Series:
        return pd.Series(bloom.has(k.to_numpy(np.int64).view(np.uint64)))

    return passes


def _member(found: list[Cascade], g: int, groups: int):
    """Asks group g's cascades of blocked and of allowed keys; others keep what they have."""

    @F.pandas_udf("array<tinyint>")
    def member(hashes: pd.Series, before: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in hashes)])
        got = np.concatenate([np.zeros(0, np.int8), *(np.asarray(x, np.int8) for x in before)])
        at = np.flatnonzero(flat % groups == g)
        k = flat[at].view(np.uint64)
        got[at] = np.where(found[0].has(k), 2, np.where(found[1].has(k), 1, 0))
        return pd.Series(np.split(got, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return member


def _members(b: DataFrame, wanted: DataFrame, keys: DataFrame, salt: int, groups: int) -> DataFrame:
    """b with __b_in: of each of its keys 2 (blocked), 1 (allowed) or 0."""
    hashed = lambda key: F.xxhash64(F.lit(salt), key)
    universe = keys.select("key", hashed("key").alias("k"))
    wanted = wanted.select("verdict", "key", hashed("key").alias("k"))
    out = b.select("*", F.transform("__b_keys", hashed).alias("__b_h"), F.transform("__b_keys", lambda x: F.lit(0).cast("tinyint")).alias("__b_in"))
    for g in range(groups):
        mine = F.pmod("k", F.lit(groups)) == g
        found = [build(wanted.where((F.col("verdict") == v) & mine), universe.where(mine)) for v in ("block", "allow")]
        out = out.withColumn("__b_in", _member(found, g, groups)("__b_h", "__b_in"))
        if groups > 1:
            out = pinned(out)  # no executor holds the cascades of two groups
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__b_url")))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__b_url, instr(__b_url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages and ``host``, ``path``, ``rule`` and ``verdict``.

    rules: (host, path, verdict), verdict block or allow; a rule fits its host
    and that host's subdomains where the url's path starts with the rule's
    path. The longest fitting rule (characters of host and path) wins, block
    before allow between rules of the same text. Without one the verdict is
    ``default``. A null url, or one without ``://``, has an empty host and
    path and fits nothing. Rules with a null are ignored, repeats are one
    rule. Existing columns of the four names are replaced.
    """
    kept = pages.drop("host", "path", "rule", "verdict")
    a = kept.select("*", F.col(url).cast("string").alias("__b_url")).select("*", host_of(F.col("__b_url")).alias("host"), path_of(F.col("__b_url")).alias("path")).drop("__b_url")
    rules = rules.where("host is not null and path is not null and verdict in ('block', 'allow')").select("host", "path", "verdict").distinct()
    # The paths' different lengths; n of them need paths of n ** 2 / 2 characters in all, so they are few.
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed_lengths = F.from_json(F.lit(str(lengths)), "array<int>")
    prefixes = F.transform(F.filter(listed_lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\x00"), p))))
    b = a.select("*", F.when(F.col("host") != "", pairs).otherwise(F.array().cast("array<string>")).alias("__b_keys"))
    keys = pinned(b.select(F.explode("__b_keys").alias("key")).distinct())
    wanted = rules.select("verdict", F.concat("host", F.lit("\x00"), "path").alias("key"))
    n, salt, groups = keys.count(), 0, 1
    # A level 1 holds RATE of the universe; half of a bound is aimed at.
    groups = max(1, math.ceil(2 * max(wanted.count(), RATE * n) * KEY_BITS / 8 / MOST_BYTES))
    while True:
        try:
            c = _members(b, wanted, keys, salt, groups)
            break
        except Crowded:
            groups *= 2
        except Collision:
            salt += 1
    fits = F.filter(F.transform("__b_keys", lambda x, i: F.struct(F.length(x).alias("n"), F.get("__b_in", i).alias("v"), x.alias("key"))), lambda s: s["v"] > 0)
    d = c.select("*", F.array_max(fits).alias("__b_best"))
    rule = F.translate(F.col("__b_best.key"), "\x00", "")
    verdict = F.when(F.col("__b_best.v") == 2, "block").when(F.col("__b_best.v") == 1, "allow").otherwise(default)
    return d.select(*kept.columns, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


# The rules that the query asks for.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
