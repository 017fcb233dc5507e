"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; what it returns is written
as Parquet and read again as the next one's `docs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarifflume.llm import decontaminate, language_id, ngram_join, packing, substring_dedup
from tarifflume.llm.common import shared_folder, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language; the model is learned from the labelled ones."""
    return language_id.with_language(docs, language_id.train(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, similarity 0.8 or more), the smallest doc_id."""
    return ngram_join.first_of_each(docs, n=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 50 words or more that an earlier document holds too."""
    return substring_dedup.without_repeats(docs, length=50)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 0.8 or more of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, each with its sequence and its place there."""
    return packing.pack(docs, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("near_duplicates", deduplicated),
    ("repeated_passages", without_repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
