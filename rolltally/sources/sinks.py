"""Sinks: rollout log and evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.operators.vote import PROMPT


def log_flags(labelled: DataFrame, selected: DataFrame) -> DataFrame:
    """``prompt_id, rollout_idx, answer, is_selected, is_majority, direction_sign`` (0 when not selected) of every rollout; no texts.

    ``labelled`` holds every rollout with ``answer, is_majority``.
    """
    picks = selected.select(*PROMPT, "rollout_idx", F.col("direction_sign").alias("_sign"))
    return labelled.join(picks, [*PROMPT, "rollout_idx"], "left").select(
        *PROMPT,
        "rollout_idx",
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.col("_sign").isNotNull().alias("is_selected"),
        "is_majority",
        F.coalesce("_sign", F.lit(0)).alias("direction_sign"),
    )


def log_texts(rollouts: DataFrame, prompt: Column, step: Column) -> DataFrame:
    """``step``, ids, the rendered ``prompt``, completion and truth of every rollout."""
    return rollouts.select(
        step.cast("bigint").alias("step"), *PROMPT, "rollout_idx", prompt.alias("prompt"), "completion", F.coalesce("ground_truth", F.lit("")).alias("ground_truth")
    )


def rollout_log(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per rollout: texts, selected and majority flags, direction."""
    return texts.join(flags, [*PROMPT, "rollout_idx"])


def flush_step(step: Column, every: int = 5) -> Column:
    """Step at which a row is written: the next multiple of ``every``, step 0 with the first flush."""
    return F.greatest(F.ceil(step / every) * every, F.lit(every)).cast("bigint")


def write_rollout_log(log: DataFrame, path: str, every: int = 5, fmt: str = "parquet") -> None:
    """Write the log partitioned by flush step.

    The rebalance hint brings rows of a step together, so that not every task writes a file for every step, and
    lets AQE cut a step that is too big into several files.
    """
    flushed = log.withColumn("flush_step", flush_step(F.col("step"), every))
    flushed.hint("rebalance", "flush_step").write.mode("append").partitionBy("flush_step").format(fmt).save(path)


def log_samples(log: DataFrame) -> DataFrame:
    """``num_samples`` of every flush."""
    return log.groupBy("flush_step").agg(F.count(F.lit(1)).alias("num_samples"))


def write_eval_report(summary: DataFrame, results: DataFrame, generations: DataFrame, path: str, fmt: str = "json") -> None:
    """Summary, per-problem results and generations side by side under ``path``; the two large ones are compressed, as most of a generation repeats."""
    summary.write.mode("overwrite").format(fmt).save(f"{path}/summary")
    for name, table in (("results", results), ("generations", generations)):
        writer = table.hint("rebalance", "dataset").write.mode("overwrite").partitionBy("dataset").option("compression", "gzip")
        writer.format(fmt).save(f"{path}/{name}")
