"""The end-to-end job: texts to repaired answers to votes to a report against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.functions.answers import answer_key, has_answer
from rolltally.operators.vote import majority_vote, with_repairs, with_texts
from rolltally.sources import views


def vote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prompt: label, votes, rollouts, and whether the label is right (null without a truth).

    Nothing is staged: the text is scanned once, only answers reach the exchanges, and each prompt's distinct ones are keyed.
    """
    answers = with_repairs(with_texts(views.build_rollouts(spark, sf_dir))).select("prompt_id", "rollout_idx", "answer")
    votes = majority_vote(answers)
    truth = views.problems(spark, sf_dir).select("prompt_id", "ground_truth")
    right = F.coalesce(F.col("label_key") == answer_key(F.col("ground_truth")), F.lit(False))
    return votes.join(truth, "prompt_id", "left").select(
        "prompt_id",
        "pseudo_label",
        "consensus_count",
        "n_rollouts",
        F.when(has_answer(F.col("ground_truth")), right).alias("vote_correct"),
    )
