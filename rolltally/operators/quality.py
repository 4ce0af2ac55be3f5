"""Label-quality and selection metrics as ratios of sums.

All of them need answers only up to equivalence, so they start from ``clusters``: one row per prompt and
answer key with its number of rollouts. Joins then run on this reduced table, never on the rollouts,
and every figure is a numerator and a denominator summed over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions.answers import answer_key, has_answer
from rolltally.operators.vote import PROMPT, has_consensus


def clusters(answers: DataFrame) -> DataFrame:
    """Rollouts per prompt and answer key; the null key gathers those without an answer."""
    return answers.groupBy(*PROMPT, "answer_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two sums, 0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def _truths(problems: DataFrame, truth: str) -> DataFrame:
    usable = has_answer(F.col(truth))
    return problems.select(*PROMPT, usable.alias("has_truth"), F.when(usable, answer_key(F.col(truth))).alias("truth_key"))


def _same(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def _n_if(condition: Column, value: Column | None = None) -> Column:
    return F.sum(F.when(condition, F.lit(1) if value is None else value).otherwise(0))


def _known(table: DataFrame, problems: DataFrame, truth: str) -> DataFrame:
    """Rows of prompts with a usable truth."""
    return table.join(_truths(problems, truth).where("has_truth"), PROMPT)


def rollout_accuracy(groups: DataFrame, votes: DataFrame, problems: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Share of answers that are right, share of labels that are right, share of prompts with a right rollout."""
    rows = _known(groups, problems, truth)
    hit = _same("answer_key", "truth_key")
    right, answered = _n_if(hit, F.col("n")), _n_if(F.col("answer_key").isNotNull(), F.col("n"))
    per_rollout = rows.agg(ratio(right, answered).alias("rollout_accuracy"), _n_if(hit).alias("_solved"))
    labels = _known(votes, problems, truth)
    labelled = has_answer(F.col("pseudo_label"))
    per_prompt = labels.agg(
        ratio(_n_if(labelled & _same("label_key", "truth_key")), _n_if(labelled)).alias("vote_accuracy"),
        F.count(F.lit(1)).alias("_prompts"),
    )
    return side_by_side(per_rollout, per_prompt).select(
        "rollout_accuracy", "vote_accuracy", ratio(F.col("_solved"), F.col("_prompts")).alias("pass_at_k")
    )


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates in one row: stacked with nulls, then collapsed. No join."""
    stacked = one_row[0]
    for other in one_row[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def wrong_label_neither(groups: DataFrame, votes: DataFrame, problems: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Where the label is wrong: share of all rollouts equal neither to it nor to the truth."""
    labels = votes.where(has_answer(F.col("pseudo_label"))).select(*PROMPT, "label_key")
    rows = _known(groups, problems, truth).join(labels, PROMPT).where(~_same("label_key", "truth_key"))
    neither = _n_if(~_same("answer_key", "label_key") & ~_same("answer_key", "truth_key"), F.col("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return rows.agg(
        F.coalesce(neither, F.lit(0)).alias("neither"),
        total.alias("total"),
        ratio(neither, total).alias("wrong_label_neither_fraction"),
    )


def signal_accuracy(
    answers: DataFrame,
    groups: DataFrame,
    votes: DataFrame,
    selected: DataFrame,
    problems: DataFrame,
    threshold: int,
    truth: str = "ground_truth",
) -> DataFrame:
    """Agreement of directions with the truth's direction: for every rollout, and for the selected ones.

    Under consensus a group of equal answers is right or wrong as a whole. Without it all are -1 but one,
    which is the only row to look at by itself.
    """
    rank = F.when(has_answer(F.col("answer")), F.struct("n_tokens", "rollout_idx", "answer_key"))
    trusted = answers.groupBy(*PROMPT).agg(F.min(rank).alias("_t")).select(*PROMPT, F.col("_t.answer_key").alias("trusted_key"))
    agreed = has_consensus(threshold)
    labels = votes.select(*PROMPT, "label_key", agreed.alias("agreed"))
    rows = _known(groups, problems, truth).join(labels, PROMPT)
    by_label = _same("answer_key", "label_key") == _same("answer_key", "truth_key")
    right = F.when(F.col("agreed"), by_label).otherwise(~_same("answer_key", "truth_key"))
    every = rows.agg(_n_if(right, F.col("n")).alias("_right"), F.sum("n").alias("_total"))
    # The trusted rollout was counted as -1 above: it is one more or one fewer right direction.
    lone = _known(trusted.where("trusted_key is not null"), problems, truth).join(labels.where(~F.col("agreed")), PROMPT)
    fix = lone.agg(F.coalesce(F.sum(F.when(_same("trusted_key", "truth_key"), 1).otherwise(-1)), F.lit(0)).alias("_fix"))
    update = _known(selected, problems, truth).agg(
        _n_if((F.col("direction_sign") > 0) == _same("answer_key", "truth_key")).alias("_u"), F.count(F.lit(1)).alias("_un")
    )
    return side_by_side(every, fix, update).select(
        ratio(F.col("_right") + F.col("_fix"), F.col("_total")).alias("signal_accuracy"),
        ratio(F.col("_u"), F.col("_un")).alias("update_signal_accuracy"),
    )


def selection_metrics(raw_groups: DataFrame, votes: DataFrame, selected: DataFrame, threshold: int, k_train: int) -> DataFrame:
    """Shares and lengths describing one selection; ``raw_groups`` are the answers before repair."""
    agreed = has_consensus(threshold)
    prompts = votes.agg(
        F.sum(F.when(agreed, F.col("consensus_count")).otherwise(0)).alias("_pos"),
        F.sum("n_rollouts").alias("_all"),
        F.avg("consensus_count").alias("consensus_mean"),
        F.count_if(F.col("consensus_count") >= threshold).alias("prompts_with_consensus"),
        F.count(F.lit(1)).alias("_prompts"),
    )
    rows = selected.agg(
        F.avg((F.col("direction_sign") > 0).cast("double")).alias("update_positive_fraction"),
        F.count_if(~F.col("agreed") & ~has_answer(F.col("answer"))).alias("_filled"),
        F.avg("n_tokens").alias("selected_len_mean"),
        F.max("n_tokens").alias("selected_len_max"),
    )
    found = raw_groups.agg(ratio(_n_if(F.col("answer_key").isNotNull(), F.col("n")), F.sum("n")).alias("extractable_fraction"))
    return side_by_side(prompts, rows, found).select(
        ratio(F.col("_pos"), F.col("_all")).alias("positive_fraction"),
        "update_positive_fraction",
        "extractable_fraction",
        ratio(F.col("_filled"), F.col("_prompts") * k_train).alias("backfill_fraction"),
        "consensus_mean",
        "prompts_with_consensus",
        "selected_len_mean",
        "selected_len_max",
    )


def vote_metrics(groups: DataFrame, votes: DataFrame, problems: DataFrame, threshold: int, truth: str = "ground_truth") -> DataFrame:
    """Test-time vote report. The majority ratio is a mean of per-prompt ratios; the rest are ratios of sums."""
    agreed = has_consensus(threshold)
    rewarded = F.sum(F.when(agreed, F.col("consensus_count")).otherwise(0))
    prompts = votes.agg(
        F.avg("consensus_count").alias("consensus_mean"),
        F.avg(F.col("consensus_count") / F.col("n_rollouts")).alias("majority_ratio"),
        F.count_if(agreed).alias("prompts_with_consensus"),
        F.count_if(~agreed).alias("prompts_without_consensus"),
        ratio(rewarded, F.sum("n_rollouts")).alias("reward_mean"),
        ratio(rewarded, F.sum("n_rollouts")).alias("positive_fraction"),
    )
    found = groups.agg(ratio(_n_if(F.col("answer_key").isNotNull(), F.col("n")), F.sum("n")).alias("extractable_fraction"))
    accuracy = rollout_accuracy(groups, votes, problems, truth).select("vote_accuracy", F.col("pass_at_k").alias("pass_at_n"))
    return side_by_side(prompts, found, accuracy)


def shard_sums(answers: DataFrame, shard: Column, truth: str = "ground_truth") -> DataFrame:
    """Partial sums of one shard, as a worker would report them."""
    right = F.coalesce(F.col("answer_key") == answer_key(F.col(truth)), F.lit(False))
    usable = has_answer(F.col(truth)) & F.col("answer_key").isNotNull()
    return answers.groupBy(shard.alias("shard")).agg(
        _n_if(usable & right).alias("right"),
        _n_if(usable).alias("answered"),
        F.sum("n_tokens").alias("tokens"),
        F.count(F.lit(1)).alias("rollouts"),
        F.max("n_tokens").alias("longest"),
    )


def combine_shards(sums: DataFrame) -> DataFrame:
    """Totals of all shards first, ratios last; maxima are combined as maxima."""
    return sums.agg(
        ratio(F.sum("right"), F.sum("answered")).alias("rollout_accuracy"),
        ratio(F.sum("tokens"), F.sum("rollouts")).alias("len_mean"),
        F.max("longest").alias("len_max"),
    )


def greedy_extraction_rate(greedy: DataFrame) -> DataFrame:
    """Share of one-per-prompt answers that are not empty."""
    return greedy.agg(F.avg(has_answer(F.col("answer")).cast("double")).alias("greedy_extraction_rate"))


def generation_throughput(log: DataFrame, call: str = "call") -> DataFrame:
    """Rows, tokens, mean length and tokens per second of each generation call."""
    tokens = F.sum("n_tokens")
    return log.groupBy(call).agg(
        F.count(F.lit(1)).alias("n_rows"),
        tokens.alias("total_tokens"),
        F.avg("n_tokens").alias("mean_len"),
        (tokens / F.greatest(F.sum("elapsed"), F.lit(1e-6))).alias("tokens_per_s"),
    )
