"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in Spark expression over the row's own text, so the
whole operator is a scan and a projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words, and the counted symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was are this by from or at an which you not but "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des un une et est que qui dans pour pas sur par au avec ce il en ne plus "
    "el los las del y que se por con para una su al lo como más pero sus si no o"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when measure < low or measure > high (None: no bound)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The table. Measures are SQL over the columns of :func:`measured`.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, 0.9),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("shouting_ratio", "n_exclaimed / n_words", None, 0.5),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``__q_m``, a struct of all counts. A null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    a = docs.select("*", t.alias("__q_t")).select("*", _words(F.col("__q_t")).alias("__q_w"), F.filter(F.split(F.col("__q_t"), "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("__q_l"))
    n = F.size("__q_w")
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__q_w", i), F.get("__q_w", i + 1), F.get("__q_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select("*", windows.alias("__q_h"))
    # Windows in hash order next to their copies; only texts that repeat one are sorted.
    order = F.when(F.size(F.array_distinct("__q_h")) < F.size("__q_h"), F.sort_array(F.transform("__q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    c = b.select("*", order.alias("__q_o"))
    same = lambda s, j: F.get("__q_o", j - 1)["h"].eqNullSafe(s["h"]) | F.get("__q_o", j + 1)["h"].eqNullSafe(s["h"])
    starts = F.sort_array(F.transform(F.filter("__q_o", same), lambda s: s["i"]))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    d = c.select("*", F.aggregate(starts, zero, step, lambda acc: acc["n"]).alias("__q_r"))
    stop = F.size(F.filter("__q_w", lambda w: F.lower(F.translate(w, ".,;:!?\"()", "")).isin(STOP_WORDS)))
    counts = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("__q_t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("__q_t") - F.length(F.translate("__q_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("bigint").alias("n_dup_lines"),
        F.col("__q_r").alias("n_repeat_words"),
        F.size("__q_l").cast("bigint").alias("n_lines"),
        stop.cast("bigint").alias("n_stop_words"),
        (F.length("__q_t") - F.length(F.translate("__q_t", "!", ""))).cast("bigint").alias("n_exclaimed"),
    )
    return d.select(*docs.columns, counts.alias("__q_m"))


def base_failed(m: str = "__q_m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def verdict(rules: tuple[Rule, ...] = RULES, m: str = "__q_m") -> Column:
    """Names of the failed rules, as one array expression compiled from the table.
    A measure without a value (no words, no lines) fails nothing."""
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_exclaimed".split()

    def failed(r: Rule) -> Column:
        over, under = (x.strip() for x in r.measure.split("/"))
        assert over in fields and under in fields, r
        value = F.when(F.col(f"{m}.{under}") > 0, F.col(f"{m}.{over}") / F.col(f"{m}.{under}"))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name))

    return F.filter(F.array(*map(failed, rules)), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs and ``__q_m`` (counts), ``__q_base`` (the base rules fail), ``__q_failed``
    (names of the failed table rules), ``__q_kept``.

    Null and empty texts have no words and so fail the base rules; rows are
    judged one by one, so repeated rows and ids, ties, nulls in other columns
    and extra columns change nothing; an empty table gives an empty table.
    """
    m = measured(docs, text).select("*", base_failed().alias("__q_base"), verdict(rules).alias("__q_failed"))
    # The always true part isn't deterministic to the optimiser: a filter on the
    # verdict stays above the measures, which would else be copied into it.
    barrier = F.monotonically_increasing_id() >= 0
    return m.select("*", (~F.col("__q_base") & (F.size("__q_failed") == 0) & barrier).alias("__q_kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    return judge(docs).where("__q_kept").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    m = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.select("doc_id", *(F.col(f"__q_m.{x}").alias(x) for x in names), F.col("__q_base").alias("base_failed"), F.col("__q_kept").alias("kept"))
