"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash, packing, quality_classifier, quality_rules, suffix_dedup
from tidemark.llm.common import drop_path, stash_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from a bounded sample
    of the labelled rows of the raw documents, as what the rules have rejected
    is most of what there is to learn from."""
    net = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, net)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out."""
    return suffix_dedup.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    return packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("minhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("packing", packed),
]

#: The classifier and the packing order cannot be written in SQL; tests check
#: each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = stash_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
