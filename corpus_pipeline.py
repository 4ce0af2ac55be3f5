"""From raw documents to packed training sequences: language ID, near-dedup, substring dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolltally.llm import language_id, minhash_dedup, mixing, packing, substring_dedup
from rolltally.llm.store import store
from rolltally.plans.session import configure


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those like no language of the labelled ones."""
    configure(spark)
    return language_id.in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates."""
    configure(spark)
    return minhash_dedup.keep_representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words out that stand in a window of 13 which a document of smaller id has, too."""
    configure(spark)
    return substring_dedup.drop_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the target size of their source."""
    configure(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    configure(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Language profiles, tokenization and the genetic algorithm have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
