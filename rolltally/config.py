"""Operator parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VoteParams:
    """Majority vote and routing."""

    min_consensus: int = 2
    use_ground_truth: bool = False

    @property
    def threshold(self) -> int:
        """Votes a prompt needs; routing by ground truth needs none."""
        return 0 if self.use_ground_truth else self.min_consensus


@dataclass(frozen=True)
class SelectParams:
    """Which rollouts of a prompt are kept.

    ``positive_fraction``: share of agreeing rollouts in [0, 1]; ``-1`` balances by square
    roots of the class sizes; ``-2`` takes the first ``k_train`` rollouts as they come.
    Strategies: 0 shortest, 1 highest divergence, 2 highest log-probability, 3 longest,
    anything else keeps the sampling order.
    """

    k_train: int = 8
    positive_fraction: float = 0.5
    pos_select: int = 0
    neg_select: int = 0

    def __post_init__(self) -> None:
        if self.k_train < 1:
            raise ValueError("k_train must be at least 1")
        if not (self.positive_fraction in (-1, -2) or 0 <= self.positive_fraction <= 1):
            raise ValueError("positive_fraction must be in [0, 1], -1 or -2")


@dataclass(frozen=True)
class LossParams:
    """Per-token divergence and policy-gradient statistics."""

    temperature: float = 1.1
    clip: float | None = 0.05
    clip_mode: str = "element"
    kl_mode: float = -3
    rl_weight: float = 0.1
    retention: float = 0.0
    use_token_masking: bool = True

    def __post_init__(self) -> None:
        if self.clip_mode not in ("element", "token"):
            raise ValueError("clip_mode must be 'element' or 'token'")
        if not (0 <= self.kl_mode <= 1 or self.kl_mode in (-1, -2, -3, -4)):
            raise ValueError("kl_mode must be in [0, 1], -1, -2, -3 or -4")
        if not 0 <= self.retention <= 1:
            raise ValueError("retention must be in [0, 1]")


@dataclass(frozen=True)
class BatchParams:
    """How selected rollouts are packed into optimiser steps."""

    batch: int = 1
    accumulation: int = 8
    k_train: int = 8

    @property
    def prompts_per_step(self) -> int:
        total = self.batch * self.accumulation
        if total % self.k_train:
            raise ValueError(f"batch * accumulation = {total} must be divisible by k_train = {self.k_train}")
        return total // self.k_train
