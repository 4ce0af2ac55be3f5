"""Rewards, group-relative advantages and the registry of reward functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions.answers import answer_key, has_answer
from rolltally.operators.vote import has_consensus, join_votes

RewardFunction = Callable[..., Column]
_registry: dict[str, RewardFunction] = {}


def register_reward(name: str, build: RewardFunction) -> None:
    """Add a reward: a function that returns a numeric column over the rollout table.

    Built-in functions keep it inside code generation; a pandas UDF column works where they cannot say it.
    """
    _registry[name] = build


def reward_column(name: str, **params) -> Column:
    if name not in _registry:
        raise ValueError(f"unknown reward {name!r}; known: {sorted(_registry)}")
    return _registry[name](**params).cast("double")


def with_rewards(rollouts: DataFrame, names: list[str]) -> DataFrame:
    """One ``reward_<name>`` column per registered reward, in one projection."""
    return rollouts.select("*", *[reward_column(n).alias(f"reward_{n}") for n in names])


def ground_truth_reward(truth: str = "ground_truth") -> Column:
    """1 for an answer equal to the truth by value or normalised text, else 0."""
    same = F.col("answer_key") == answer_key(F.col(truth))
    return F.coalesce(same, F.lit(False)).cast("double")


def formatted_reward() -> Column:
    """1 when there is an answer at all."""
    return has_answer(F.col("answer")).cast("double")


register_reward("ground_truth", ground_truth_reward)
register_reward("formatted", formatted_reward)


def majority_reward(answers: DataFrame, votes: DataFrame, threshold: int) -> DataFrame:
    """1 for the winning group of a prompt with consensus, 0 for everyone otherwise."""
    won = F.col("is_majority") & has_consensus(threshold)
    return join_votes(answers, votes).withColumn("reward", F.coalesce(won, F.lit(False)).cast("double"))


def advantages(selected: DataFrame, threshold: int) -> DataFrame:
    """Group-relative advantage of selected rollouts, over all rollouts of the prompt.

    Mean and population deviation of a 0/1 reward are closed forms of the vote count, so no window is
    needed. Only the count decides about consensus here; without it both are 0.
    """
    n_pos = F.when(F.col("consensus_count") >= threshold, F.col("consensus_count")).otherwise(0).cast("double")
    k = F.col("n_rollouts").cast("double")
    mean = n_pos / k
    spread = F.sqrt((n_pos * (1 - mean) * (1 - mean) + (k - n_pos) * mean * mean) / k)
    reward = F.when(F.col("direction_sign") > 0, 1.0).otherwise(0.0)
    return selected.withColumn(
        "advantage", F.when(spread > 1e-8, (reward - mean) / (spread + 1e-6)).otherwise(reward - mean)
    )
