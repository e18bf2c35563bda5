"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet to
the folder that ``spark.checkpoint.dir`` names and read again as the next
one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wovengraph.llm import exact_dedup, jaccard, language, packing, quality
from wovengraph.llm.common import settle, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose Bradley-Terry score reaches 0.3; preferences come from the labels of the folder."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which one language has at least half of the mixture."""
    return language.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, A-Z as a-z: the largest doc_id."""
    return exact_dedup.unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of texts linked by five-word shingles with similarity 0.8 or more: the smallest doc_id."""
    return jaccard.representatives(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their bins."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("best-fit packing", pack),
]

# Learned scores and packing cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
