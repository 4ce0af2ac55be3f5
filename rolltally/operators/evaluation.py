"""Benchmark evaluation: grading, per-problem and summary tables, progress, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions import answers as A
from rolltally.operators.ordering import running
from rolltally.operators.vote import majority_vote_raw, with_answers

PROBLEM = ["dataset", "problem_id"]


def grade(rollouts: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Add ``formatted`` (an empty box counts) and ``correct`` to rollouts with evaluation answers."""
    same = F.col("answer_key") == A.answer_key_eval(F.col(truth))
    return rollouts.withColumn("formatted", F.col("answer").isNotNull()).withColumn(
        "correct", F.coalesce(same, F.lit(False))
    )


def shown_answer() -> Column:
    return F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(A.NO_ANSWER))


def per_problem(graded: DataFrame) -> DataFrame:
    """Counts, pass@n, majority vote and first-rollout fields of every problem.

    Rollouts with the same text are merged first (map-side), so the second grouping sees one row per
    problem and distinct answer.
    """
    variants = graded.groupBy(*PROBLEM, shown_answer().alias("_shown"), "formatted", "correct").agg(
        F.count(F.lit(1)).alias("_n"), F.min("rollout_idx").alias("_first")
    )
    votes = F.when(F.col("formatted"), F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first")))
    total = variants.groupBy(*PROBLEM).agg(
        F.sum("_n").alias("n_solutions"),
        F.sum(F.when(F.col("correct"), F.col("_n")).otherwise(0)).alias("num_correct"),
        F.sum(F.when(F.col("formatted"), F.col("_n")).otherwise(0)).alias("num_formatted"),
        F.bool_or("correct").alias("pass_at_n"),
        F.min_by("correct", votes).alias("_vote_ok"),
        F.min_by(F.struct("_shown", "correct", "formatted"), F.col("_first")).alias("_head"),
    )
    return total.select(
        *PROBLEM,
        "n_solutions",
        "num_correct",
        "num_formatted",
        "pass_at_n",
        F.coalesce("_vote_ok", F.lit(False)).alias("majority_vote_correct"),
        F.col("_head._shown").alias("predicted_answer"),
        F.col("_head.correct").alias("correct"),
        F.col("_head.formatted").alias("formatted"),
    )


def summary(problems: DataFrame, by: list[str] = ["dataset"]) -> DataFrame:
    """Percentages per dataset: pass and majority over problems, average and format over solutions."""
    n, total = F.count(F.lit(1)), F.sum("n_solutions")
    passed, voted = F.count_if("pass_at_n"), F.count_if("majority_vote_correct")
    return problems.groupBy(*by).agg(
        n.alias("num_problems"),
        total.alias("total_solutions"),
        passed.alias("pass_at_n"),
        (passed / n * 100).alias("pass_at_n_pct"),
        F.sum("num_correct").alias("average_at_n"),
        (F.sum("num_correct") / total * 100).alias("average_at_n_pct"),
        voted.alias("majority_vote_at_n"),
        (voted / n * 100).alias("majority_vote_at_n_pct"),
        F.sum("num_formatted").alias("formatted_count"),
        (F.sum("num_formatted") / total * 100).alias("format_rate"),
    )


def graded_texts(rollouts: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Rollouts with answer and grade next to their completion, in one pass over the text.

    Grading again while reading is cheaper than joining grades to texts: long completions stay where they are.
    """
    rows = with_answers(rollouts.withColumn("_text", F.col("completion")), "_text", "last")
    return grade(rows, truth)


def generations(rows: DataFrame) -> DataFrame:
    """One row per generation, keyed by problem and rollout, from ``graded_texts``. A problem may have any number."""
    return rows.select(
        *PROBLEM,
        "rollout_idx",
        shown_answer().alias("predicted_answer"),
        F.col("completion").alias("full_generation"),
        "correct",
        "formatted",
    )


def report(problems: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per problem: totals, text, truth, number of samples and the first generation, ready for a JSON sink.

    ``rows`` are ``graded_texts`` with ``problem`` and ``ground_truth``. All generations are a table of their own.
    """
    first = rows.groupBy(*PROBLEM).agg(
        F.min_by(F.struct("problem", "ground_truth", F.col("completion").alias("full_generation")), "rollout_idx").alias("_first")
    )
    return problems.join(first, PROBLEM).select(
        *PROBLEM, "_first.problem", "_first.ground_truth", F.col("n_solutions").alias("val_n"), "num_correct", "pass_at_n",
        "majority_vote_correct", "predicted_answer", "_first.full_generation", "correct", "formatted",
    )


def running_metrics(problems: DataFrame, seq: str = "seq", rows_per_block: int = 1 << 16) -> DataFrame:
    """Progress after each problem in dataset order: cumulative pass@n, avg@n and format rate.

    A dataset is one ordered group of any size, so the totals are carried from block to block.
    """
    block = F.floor(F.col(seq) / rows_per_block).cast("bigint")
    totals = running(
        problems,
        ["dataset"],
        [F.col(seq)],
        block,
        {
            "_seen": ("count", F.lit(1)),
            "_pass": ("sum", F.col("pass_at_n").cast("bigint")),
            "_ok": ("sum", F.col("num_correct")),
            "_fmt": ("sum", F.col("num_formatted")),
            "_all": ("sum", F.col("n_solutions")),
        },
    )
    return totals.select(
        *PROBLEM,
        F.col("_seen").alias("done"),
        "pass_at_n",
        "num_correct",
        (F.col("_pass") / F.col("_seen") * 100).alias("running_pass_at_n"),
        (F.col("_ok") / F.col("_all") * 100).alias("running_avg_at_n"),
        (F.col("_fmt") / F.col("_all") * 100).alias("running_format_rate"),
    )


def progress(problems: DataFrame, every: int = 10, seq: str = "seq") -> DataFrame:
    """The detailed line after every ``every``-th problem."""
    return running_metrics(problems, seq).where(F.col("done") % every == 0)


def validation(graded: DataFrame, val_n: int, truth: str = "ground_truth") -> DataFrame:
    """Training-time avg@n / pass@n; problems without truth are left out, avg divides by the fixed ``val_n``."""
    per = graded.where(A.has_answer(F.col(truth))).groupBy("prompt_id").agg(F.count_if("correct").alias("_ok"))
    return per.agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.avg(F.col("_ok") / val_n).alias("avg_at_n"),
        F.avg((F.col("_ok") > 0).cast("double")).alias("pass_at_n"),
    )


__all__ = [
    "generations", "grade", "graded_texts", "majority_vote_raw", "per_problem", "progress", "report", "running_metrics",
    "summary", "validation",
]
