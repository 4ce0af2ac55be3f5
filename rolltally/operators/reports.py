"""Comparison tables over evaluation scores. Inputs are aggregated: one row per model, method, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(scores: DataFrame, benchmarks: list[str]) -> DataFrame:
    """One row per model and method, a column per benchmark, and their unweighted mean."""
    table = scores.groupBy("model", "method").pivot("benchmark", benchmarks).agg(F.avg("score"))
    mean = sum((F.col(b) for b in benchmarks[1:]), F.col(benchmarks[0])) / len(benchmarks)
    return table.withColumn("average", mean)


def gain_over_base(scores: DataFrame, base: str = "Base") -> DataFrame:
    """Score minus the base method's score of the same model and benchmark."""
    reference = scores.where(F.col("method") == base).select("model", "benchmark", F.col("score").alias("base_score"))
    return scores.join(reference, ["model", "benchmark"], "left").withColumn("gain", F.col("score") - F.col("base_score"))


def best_per_benchmark(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Mark the best method(s) per model and benchmark; equal scores are all marked."""
    peers = Window.partitionBy("model", "benchmark").orderBy(F.round("score", digits).desc())
    return scores.withColumn("is_best", F.rank().over(peers) == 1)


def checkpoint_sweep(summaries: DataFrame, score: str = "average_at_n_pct") -> DataFrame:
    """Score of each checkpoint with its gain over the base model (null checkpoint) on the same dataset."""
    base = summaries.where(F.col("checkpoint").isNull()).select("dataset", F.col(score).alias("base_score"))
    return summaries.join(base, "dataset", "left").select(
        "dataset", "checkpoint", F.col(score).alias("score"), (F.col(score) - F.col("base_score")).alias("gain")
    )


def cross_benchmark_gain(scores: DataFrame, benchmarks: list[str], base: str = "Base") -> DataFrame:
    """Matrix of gains: trained on (row) against tested on (column)."""
    reference = scores.where(F.col("trained_on") == base).select("tested_on", F.col("score").alias("base_score"))
    gains = scores.where(F.col("trained_on") != base).join(reference, "tested_on").withColumn(
        "gain", F.col("score") - F.col("base_score")
    )
    return gains.groupBy("trained_on").pivot("tested_on", benchmarks).agg(F.avg("gain"))
