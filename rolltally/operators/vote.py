"""Answers, majority vote, routing by ground truth and the joins around them.

The unit of work is a narrow table ``answers(prompt, rollout_idx, n_tokens, answer, answer_key, ...)``.
Completions are read once by ``with_answers`` and do not travel through any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions import answers as A
from rolltally.functions.prompts import merge_repair

PROMPT = ["prompt_id"]


def with_answers(rollouts: DataFrame, text: str = "completion", rule: str = "first") -> DataFrame:
    """Replace the text column by ``answer`` and ``answer_key``."""
    key = A.answer_key if rule == "first" else A.answer_key_eval
    return with_texts(rollouts, text, rule).withColumn("answer_key", key(F.col("answer")))


def with_texts(rollouts: DataFrame, text: str = "completion", rule: str = "first") -> DataFrame:
    """Replace the text column by ``answer``, not keyed yet.

    ``rule``: ``first`` box after the thinking (voting) or ``last`` box anywhere (evaluation). Each step is its
    own projection so that no long text expression is evaluated twice.
    """
    body = A.after_first_box if rule == "first" else A.after_last_box
    return (
        rollouts.withColumn("_body", body(F.col(text)))
        .withColumn("answer", A.strip(A.brace_content(F.col("_body"))))
        .drop("_body", text)
    )


def with_repairs(answers: DataFrame, continuation: str = "continuation", key=A.answer_key) -> DataFrame:
    """Fold forced continuations into answers before anything votes on them.

    ``answer`` becomes the forced one where extraction found nothing, ``extracted`` and ``recovered`` say where an answer came from; the continuation is
    dropped. Where answers are keyed already, ``answer_key`` is made anew for recovered rows; else keys come after.
    """
    found = A.has_answer(F.col("answer"))
    merged = answers.withColumn("extracted", found).withColumn("answer", merge_repair(F.col("answer"), F.col(continuation)))
    recovered = ~F.col("extracted") & A.has_answer(F.col("answer"))
    merged = merged.withColumn("recovered", recovered).drop(continuation)
    if "answer_key" not in answers.columns:
        return merged
    again = key(F.when(F.col("recovered"), F.col("answer")))
    return merged.withColumn("answer_key", F.when(F.col("recovered"), again).otherwise(F.col("answer_key")))


def repair_rates(answers: DataFrame) -> DataFrame:
    """Share of rollouts with an extracted answer, of the others with a recovered one (null if there are none), and of all with an answer."""
    missing = F.count_if(~F.col("extracted"))
    return answers.agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        F.avg(F.col("extracted").cast("double")).alias("extraction_rate"),
        F.try_divide(F.count_if("recovered"), missing).alias("recovery_rate"),
        F.avg((F.col("extracted") | F.col("recovered")).cast("double")).alias("answer_rate"),
    )


def majority_vote(answers: DataFrame, prompt: list[str] = PROMPT, idx: str = "rollout_idx") -> DataFrame:
    """One row per prompt: ``pseudo_label, label_key, consensus_count, n_rollouts``.

    The biggest group of equivalent answers wins; ties go to the shorter representative (its first member's
    text), then to the group seen first. Null label and 0 votes without a single answer. Combinable aggregates, the
    last on one row per answer group, so a hot prompt is reduced inside the map tasks. Answers without
    keys are counted by their text first, and only the distinct texts of a prompt are keyed.
    """
    if "answer_key" in answers.columns:
        groups = answers.groupBy(*prompt, "answer_key").agg(F.count(F.lit(1)).alias("_n"), F.min_by("answer", idx).alias("_rep"), F.min(idx).alias("_first"))
    else:
        texts = answers.groupBy(*prompt, "answer").agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_first"))
        keyed = texts.withColumn("answer_key", A.answer_key(F.col("answer")))
        groups = keyed.groupBy(*prompt, "answer_key").agg(F.sum("_n").alias("_n"), F.min_by("answer", "_first").alias("_rep"), F.min("_first").alias("_first"))
    clusters = groups.withColumn("_size", F.length(A.strip(F.col("_rep"))))
    # One ordered struct: "_first" is unique, so what follows it never decides.
    rank = F.when(
        F.col("answer_key").isNotNull(), F.struct((-F.col("_n")).alias("_lost"), "_size", "_first", "_rep", "answer_key")
    )
    return (
        clusters.groupBy(*prompt)
        .agg(F.min(rank).alias("_best"), F.sum("_n").alias("n_rollouts"))
        .select(
            *prompt,
            F.col("_best._rep").alias("pseudo_label"),
            F.col("_best.answer_key").alias("label_key"),
            F.coalesce(-F.col("_best._lost"), F.lit(0)).cast("bigint").alias("consensus_count"),
            "n_rollouts",
        )
    )


def majority_vote_raw(
    graded: DataFrame, problem: list[str] = PROMPT, idx: str = "rollout_idx", flag: str = "correct"
) -> DataFrame:
    """Evaluation vote: the most frequent exact text among formatted answers, first seen on ties."""
    shown = F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(A.NO_ANSWER))
    variants = (
        graded.where(F.col("answer").isNotNull())
        .groupBy(*problem, shown.alias("_shown"), F.col(flag).alias("_ok"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_first"))
    )
    rank = F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first"))
    return (
        variants.groupBy(*problem)
        .agg(F.min_by(F.struct("_shown", "_ok", "_n"), rank).alias("_best"))
        .select(
            *problem,
            F.col("_best._shown").alias("voted_answer"),
            F.col("_best._n").alias("votes"),
            F.col("_best._ok").alias("majority_vote_correct"),
        )
    )


def route_ground_truth(answers: DataFrame, truth: str = "ground_truth", prompt: list[str] = PROMPT) -> DataFrame:
    """Votes replaced by ground truth: label = truth, count = matching rollouts. Raises where truth is missing."""
    known = F.when(A.has_answer(F.col(truth)), F.col(truth)).otherwise(
        F.raise_error(F.lit("routing by ground truth needs a ground-truth answer for every prompt"))
    )
    truth_key = A.answer_key(F.col("pseudo_label"))
    # Group by the text of the truth as well: it is one value per prompt, and the key is built once per group.
    per_key = (
        answers.groupBy(*prompt, F.col(truth), "answer_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("pseudo_label", known)
        .withColumn("label_key", truth_key)
    )
    hits = F.sum(F.when(F.col("answer_key") == F.col("label_key"), F.col("_n")).otherwise(0))
    return per_key.groupBy(*prompt, "pseudo_label", "label_key").agg(
        hits.alias("consensus_count"), F.sum("_n").alias("n_rollouts")
    )


def has_consensus(threshold: int) -> Column:
    """Enough votes *and* a label, as routing wants it."""
    return (F.col("consensus_count") >= threshold) & A.has_answer(F.col("pseudo_label"))


def consensus_gate(votes: DataFrame, threshold: int) -> DataFrame:
    """Prompts whose winner has enough votes (the count alone decides)."""
    return votes.where(F.col("consensus_count") >= threshold)


def consensus_counts(votes: DataFrame, threshold: int) -> DataFrame:
    """How many prompts pass the gate and how many do not."""
    passed = F.count_if(F.col("consensus_count") >= threshold)
    return votes.agg(
        passed.alias("prompts_with_consensus"), (F.count(F.lit(1)) - passed).alias("prompts_without_consensus")
    )


def join_votes(answers: DataFrame, votes: DataFrame, prompt: list[str] = PROMPT) -> DataFrame:
    """Votes back on the rollouts, with ``is_majority``. A hot prompt is split by AQE's skew join."""
    agree = F.coalesce(F.col("answer_key") == F.col("label_key"), F.lit(False))
    return answers.join(votes, prompt).withColumn("is_majority", agree)


def join_ground_truth(answers: DataFrame, problems: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Rollouts with their problem's truth; rows without a usable one are kept and flagged."""
    return answers.join(problems.select("prompt_id", truth), "prompt_id", "left").withColumn(
        "has_truth", A.has_answer(F.col(truth))
    )


def truth_keys(problems: DataFrame, truth: str = "ground_truth") -> DataFrame:
    return problems.select("prompt_id", A.answer_key(F.col(truth)).alias("answer_key")).where("answer_key is not null")


def matching(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """Rollouts equivalent to the truth of their prompt."""
    return answers.join(truth_keys(problems), ["prompt_id", "answer_key"], "left_semi")


def not_matching(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """Rollouts that are not, including those without an answer or without a truth."""
    return answers.join(truth_keys(problems), ["prompt_id", "answer_key"], "left_anti")


def sample_expand(prompts: DataFrame, k_train: int) -> DataFrame:
    """Every prompt row ``k_train`` times, numbered from 0."""
    return prompts.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k_train - 1))))


def vote_by_text(rollouts: DataFrame, text: str, order: list[str], truth: str = "ground_truth") -> DataFrame:
    """Vote where identical prompt texts from different sources form one group; text and truth come from its first row.

    Groups go by the text's digest, so texts are no shuffle keys: one of each travels per task.
    """
    tagged = rollouts.withColumn("_at", F.struct(*order)).withColumn("_key", F.sha2(text, 256))
    votes = majority_vote(tagged.drop(text), ["_key"], "_at")
    first = tagged.groupBy("_key").agg(F.min_by(F.struct(text, truth), "_at").alias("_first"))
    return votes.join(first, "_key").select(
        F.col(f"_first.{text}").alias(text), *[c for c in votes.columns if c != "_key"], F.col(f"_first.{truth}").alias(truth)
    )
