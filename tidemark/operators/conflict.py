"""Changes from several masters merged by time.

In order of arrival: a change whose parent row is missing is ignored; one that
isn't later than the row that is there is ignored; an insert of a row that is
there updates it, an update of a missing row inserts it; a delete removes the
row and leaves nothing behind, so an older change may bring it back.

What a run of changes does to a key depends on the row it meets, but only
through its stamp: below each of a few rising bounds the result is one and the
same, from the last bound on the row stays. Such step functions are made per
block of a key's changes and then composed, so no task needs all changes of a
hot key.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changes of one key that one task folds at most.
BLOCK = 100_000

State = tuple | None  # (stamp, payload…) of a row that is there


class Steps:
    """What a run of changes makes of a row: ``empty`` of none; of one whose
    stamp is below bounds[i] (and not below bounds[i - 1]) results[i]; of a
    later one itself."""

    def __init__(self) -> None:
        self.empty: State = None
        self.touched = False
        self.bounds: list = []
        self.results: list[State] = []

    def of(self, row: State) -> State:
        if row is None:
            return self.empty
        for bound, result in zip(self.bounds, self.results, strict=True):
            if row[0] < bound:
                return result
        return row

    def add(self, stamp, result: State) -> None:
        """One more change: to result where the row there is older or missing."""
        hit = lambda row: result if row is None or row[0] < stamp else row
        self.then(hit, [(stamp, result)])
        self.touched = True

    def then(self, after, bounds: list[tuple]) -> None:
        """Followed by the function after, whose bounds and results those are."""
        self.empty = after(self.empty)
        self.results = [after(r) for r in self.results]
        for bound, result in bounds:
            if not self.bounds or bound > self.bounds[-1]:
                self.bounds.append(bound)
                self.results.append(result)
        # Neighbours with one result are one step.
        keep = [i for i in range(len(self.bounds)) if i + 1 == len(self.bounds) or self.results[i] != self.results[i + 1]]
        self.bounds, self.results = [self.bounds[i] for i in keep], [self.results[i] for i in keep]

    def followed_by(self, other: Steps) -> None:
        self.then(other.of, list(zip(other.bounds, other.results, strict=True)))


def merge_on_time(base: DataFrame, changes: DataFrame, key: list[str], stamp: str, payload: list[str], parents: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """base (key, stamp, payload) after changes (ev_id, op, key, stamp, payload)
    in order of ev_id. Stamps compare as they are (as text, if they are text).
    parents: a table whose columns are among the changes'; a change without its
    row there is ignored. Unknown operations are an error; a null stamp is an
    error, as it compares with nothing."""
    known = changes if parents is None else changes.join(parents.distinct(), parents.columns, "left_semi")
    checked = F.when(F.col("op").isin("I", "U", "D"), F.col("op")).otherwise(F.raise_error("unknown operation").cast("string"))
    good = F.coalesce(F.col(stamp), F.raise_error("no stamp").cast(changes.schema[stamp].dataType))
    rows = known.select("ev_id", checked.alias("op"), *key, good.alias(stamp), *payload)
    # Blocks follow the order of ev_id; only keys with more changes than a block have several.
    counts = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.count("*").alias("__n"), F.min("ev_id").alias("__lo"), F.max("ev_id").alias("__hi"))
    hot = counts.where(F.col("__n") > block)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    part = F.floor((F.col("ev_id") - F.col("__lo")) * F.ceil(F.col("__n") / block) / (F.col("__hi") - F.col("__lo") + 1)).cast("long")
    placed = rows.join(hot, same, "left").select(*rows.columns, F.coalesce(part, F.lit(0)).cast("long").alias("__part"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ev_id")
        steps = Steps()
        values = [[None if pd.isna(x) else x for x in pdf[c].tolist()] for c in payload]
        for i, (op, t) in enumerate(zip(pdf["op"], pdf[stamp], strict=True)):
            steps.add(t, None if op == "D" else (t, *(v[i] for v in values)))
        out = pdf[[*key, "__part"]].head(1).copy()
        out["__steps"] = [pickle.dumps(steps)]
        return out

    schema = f"{kinds}, __part long, __steps binary"
    steps = placed.groupBy(*key, "__part").applyInPandas(folded, schema)
    result = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*key, stamp, *payload).schema)

    def applied(changes: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        row: State = None
        if len(old):
            row = tuple(None if c != stamp and pd.isna(old[c].iloc[0]) else old[c].iloc[0] for c in [stamp, *payload])
        for blob in changes.sort_values("__part")["__steps"]:
            row = pickle.loads(blob).of(row)
        names = [*key, stamp, *payload]
        if row is None:
            return pd.DataFrame()  # with columns, an empty one of text has no Arrow type that Spark takes
        first = (changes if len(changes) else old).iloc[0]
        return pd.DataFrame([[*(first[k] for k in key), *row]], columns=names)

    return steps.groupBy(*key).cogroup(base.select(*key, stamp, *payload).groupBy(*key)).applyInPandas(applied, result)


def without_alternates(base: DataFrame, changes: DataFrame, key: list[str], alternate: list[str]) -> DataFrame:
    """base without rows that share a change's alternate key under another key:
    the change takes their place."""
    c = changes.where("op <> 'D'").select(*alternate, *(F.col(k).alias(f"__{k}") for k in key)).distinct()
    other = ~F.lit(True)
    for k in key:
        other = other | ~F.col(k).eqNullSafe(F.col(f"__{k}"))
    gone = base.join(c, alternate).where(other).select(*key).distinct()
    return base.join(gone, key, "left_anti").select(*base.columns)
