"""Choosing ``k_train`` rollouts per prompt and giving them a direction (+1 distil, -1 penalise)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.config import SelectParams, VoteParams
from rolltally.functions.answers import has_answer
from rolltally.operators.ordering import top_rows
from rolltally.operators.vote import PROMPT, has_consensus, join_votes

SHORTEST, MAX_KL, MAX_LOGP, LONGEST = 0, 1, 2, 3


def strategy_order(strategy: int, idx: str = "rollout_idx") -> Column:
    """Sort key of one strategy as a struct; unknown strategies keep the sampling order."""
    size, missing = F.col("n_tokens").cast("double"), (~has_answer(F.col("answer"))).cast("double")
    zero = F.lit(0.0)
    first, second = {
        SHORTEST: lambda: (missing, size),
        MAX_KL: lambda: (-F.col("kl_score"), size),
        MAX_LOGP: lambda: (-F.col("logp_score"), size),
        LONGEST: lambda: (missing, -size),
    }.get(strategy, lambda: (zero, zero))()
    return F.struct(first.alias("a"), second.alias("b"), F.col(idx).alias("c"))


def fixed_targets(k: int, fraction: float) -> tuple[Column, Column]:
    """``round(k * fraction)`` positives (half to even), the rest negatives."""
    positives = F.bround(F.lit(float(k * fraction))).cast("bigint")
    return positives, F.lit(k) - positives


def sqrt_targets(k: int, n_pos: Column, n_neg: Column) -> tuple[Column, Column]:
    """Negatives in proportion to the square roots of the class sizes, at least one of each present class."""
    share = F.lit(k) * F.sqrt(n_neg) / (F.sqrt(n_pos) + F.sqrt(n_neg))
    neg = F.greatest(F.lit(1), F.least(F.bround(share).cast("bigint"), n_neg))
    pos = F.greatest(F.lit(1), F.least(F.lit(k) - neg, n_pos))
    neg = F.when(pos + neg < k, F.least(F.lit(k) - pos, n_neg)).otherwise(neg)
    pos = F.when(pos + neg < k, F.least(F.lit(k) - neg, n_pos)).otherwise(pos)
    return (
        F.when(n_neg == 0, F.least(F.lit(k), n_pos)).when(n_pos == 0, 0).otherwise(pos).cast("bigint"),
        F.when(n_neg == 0, 0).when(n_pos == 0, F.least(F.lit(k), n_neg)).otherwise(neg).cast("bigint"),
    )


def backfilled(k: int, n_pos: Column, n_neg: Column, want_pos: Column, want_neg: Column) -> tuple[Column, Column]:
    """Rows taken per class once a class that is too small is filled up from the other one."""
    pos, neg = F.least(n_pos, want_pos), F.least(n_neg, want_neg)
    gap = F.greatest(F.lit(k) - pos - neg, F.lit(0))
    short_pos = pos < want_pos
    pos_taken = F.when(short_pos, pos).otherwise(pos + F.least(gap, n_pos - pos))
    neg_taken = F.when(short_pos, neg + F.least(gap, n_neg - neg)).otherwise(neg)
    pos_taken = F.least(pos_taken, F.lit(k))
    return pos_taken.cast("bigint"), F.least(neg_taken, F.lit(k) - pos_taken).cast("bigint")


def class_quotas(votes: DataFrame, vote: VoteParams, sel: SelectParams) -> DataFrame:
    """Per prompt: class sizes, targets and rows finally taken of each class.

    Sizes come straight from the vote: the winner's count, and the rest of the rollouts.
    """
    n_pos = F.col("consensus_count")
    n_neg = F.col("n_rollouts") - F.col("consensus_count")
    sized = votes.withColumn("n_pos", n_pos).withColumn("n_neg", n_neg)
    targets = (
        sqrt_targets(sel.k_train, F.col("n_pos"), F.col("n_neg"))
        if sel.positive_fraction == -1
        else fixed_targets(sel.k_train, sel.positive_fraction)
    )
    sized = sized.withColumn("target_pos", targets[0]).withColumn("target_neg", targets[1])
    taken = backfilled(sel.k_train, F.col("n_pos"), F.col("n_neg"), F.col("target_pos"), F.col("target_neg"))
    return (
        sized.withColumn("agreed", has_consensus(vote.threshold))
        .withColumn("take_pos", taken[0])
        .withColumn("take_neg", taken[1])
    )


def shortest_extractable(answers: DataFrame, prompt: list[str] = PROMPT, idx: str = "rollout_idx") -> DataFrame:
    """The one rollout per prompt that is trusted without consensus: shortest with an answer, first on ties."""
    rank = F.when(has_answer(F.col("answer")), F.struct("n_tokens", idx))
    return answers.groupBy(*prompt).agg(F.min(rank).alias("_s")).select(*prompt, F.col(f"_s.{idx}").alias("trusted_idx"))


def inferred_signs(answers: DataFrame, votes: DataFrame, vote: VoteParams) -> DataFrame:
    """Direction every rollout would get: agreement under consensus, else only the trusted one is +1."""
    routed = votes.join(shortest_extractable(answers), PROMPT, "left")
    sign = F.when(has_consensus(vote.threshold), F.col("is_majority")).otherwise(
        F.coalesce(F.col("rollout_idx") == F.col("trusted_idx"), F.lit(False))
    )
    return join_votes(answers, routed).withColumn("direction_sign", F.when(sign, 1).otherwise(-1)).drop("trusted_idx")


def _fallback_signs(chosen: DataFrame) -> DataFrame:
    """Only the shortest chosen rollout with an answer is +1; at most ``2 * k_train`` rows per prompt arrive here."""
    within = Window.partitionBy(*PROMPT)
    rank = F.when(has_answer(F.col("answer")), F.struct("n_tokens", "sel_rank"))
    return chosen.withColumn("_best", F.min(rank).over(within)).withColumn(
        "direction_sign",
        F.when(F.col("agreed"), F.when(F.col("is_majority"), 1).otherwise(-1))
        .when(F.col("sel_rank") == F.col("_best.sel_rank"), 1)
        .otherwise(-1),
    )


def select_rollouts(answers: DataFrame, votes: DataFrame, vote: VoteParams, sel: SelectParams) -> DataFrame:
    """Selected rollouts with ``sel_rank`` (0-based, positives first) and ``direction_sign``.

    Per prompt and class no more than ``k_train`` rows can be taken, so the ranking window keeps only
    these inside each map task; the exact quotas then cut further.
    """
    if sel.positive_fraction == -2:
        return select_naive(answers, votes, vote, sel)
    rows = join_votes(answers, class_quotas(votes, vote, sel))
    side = F.when(~F.col("agreed"), 0).when(F.col("is_majority"), 1).otherwise(2)
    order = F.when(F.col("side") == 2, strategy_order(sel.neg_select)).otherwise(strategy_order(sel.pos_select))
    ranked = top_rows(rows.withColumn("side", side), [*PROMPT, "side"], [order], sel.k_train, "_rank")
    quota = F.when(F.col("side") == 0, sel.k_train).when(F.col("side") == 1, F.col("take_pos")).otherwise(F.col("take_neg"))
    shift = F.when(F.col("side") == 2, F.col("take_pos")).otherwise(0)
    chosen = ranked.where(F.col("_rank") <= quota).withColumn("sel_rank", (F.col("_rank") - 1 + shift).cast("bigint"))
    return _selected(_fallback_signs(chosen))


def select_naive(answers: DataFrame, votes: DataFrame, vote: VoteParams, sel: SelectParams) -> DataFrame:
    """First ``k_train`` rollouts in sampling order."""
    rows = join_votes(answers, votes.withColumn("agreed", has_consensus(vote.threshold)))
    chosen = top_rows(rows, PROMPT, ["rollout_idx"], sel.k_train, "_rank").withColumn(
        "sel_rank", (F.col("_rank") - 1).cast("bigint")
    )
    return _selected(_fallback_signs(chosen))


def _selected(df: DataFrame) -> DataFrame:
    return df.select(
        *PROMPT, "rollout_idx", "sel_rank", "direction_sign", "agreed", "answer", "answer_key", "n_tokens",
        "pseudo_label", "consensus_count", "n_rollouts",
    )


def selected_lookup(answers: DataFrame, selected: DataFrame) -> DataFrame:
    """Every rollout with its place among the selected; null when it was not chosen."""
    return answers.join(selected.select(*PROMPT, "rollout_idx", "sel_rank", "direction_sign"), [*PROMPT, "rollout_idx"], "left")


def teacher_privilege(selected: DataFrame, rollouts: DataFrame, mode: str = "answer") -> DataFrame:
    """What the teacher may see per prompt: the label, a good trajectory (label as fallback) or nothing."""
    label = F.coalesce(F.first("pseudo_label"), F.lit("")).alias("_label")
    if mode == "none":
        return selected.select(*PROMPT).distinct().withColumn("privilege", F.lit(None).cast("string"))
    if mode == "answer":
        return selected.groupBy(*PROMPT).agg(label).withColumnRenamed("_label", "privilege")
    if mode != "trajectory":
        raise ValueError("mode must be 'answer', 'trajectory' or 'none'")
    rank = F.when(F.col("direction_sign") == 1, F.struct("n_tokens", "sel_rank", "rollout_idx"))
    best = (
        selected.groupBy(*PROMPT)
        .agg(F.min(rank).alias("_b"), label)
        .select(*PROMPT, "_label", F.col("_b.rollout_idx").alias("rollout_idx"))
    )
    # One key per prompt meets the text table once; completions never pass through an aggregate.
    texts = rollouts.select(*PROMPT, "rollout_idx", "completion")
    return best.join(texts, [*PROMPT, "rollout_idx"], "left").select(
        *PROMPT, F.coalesce("completion", "_label").alias("privilege")
    )
