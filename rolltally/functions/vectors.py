"""Score vectors of one token position: log-softmax, entropy and divergences.

``ls`` and ``lt`` are the log-probabilities of student and teacher over the same vocabulary entries. Lambdas
see surrounding expressions as text to evaluate again for every element, hence ``let``: it binds a
value once per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(scores: Column, temperature: float = 1.0) -> Column:
    t = F.lit(float(temperature))

    def shifted(top: Column) -> Column:
        mass = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / t))
        return let(F.log(mass), lambda log_mass: F.transform(scores, lambda x: (x - top) / t - log_mass))

    return let(F.array_max(scores), shifted)


def log_of_probabilities(probs: Column, floor: float = 1e-8) -> Column:
    """Logs of vectors that already are probabilities, bounded below."""
    return F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(floor))))


def entropy(logp: Column, epsilon: float = 0.0) -> Column:
    """``-sum p log p``; ``epsilon`` is added inside the logarithm."""
    if epsilon:
        return -F.aggregate(logp, F.lit(0.0), lambda acc, x: acc + F.exp(x) * F.log(F.exp(x) + F.lit(epsilon)))
    return -F.aggregate(logp, F.lit(0.0), lambda acc, x: acc + F.exp(x) * x)


def sampled_logp(logp: Column, token_id: Column) -> Column:
    """Log-probability of the sampled token; negative ids read entry 0 and must be masked later."""
    return F.element_at(logp, (F.greatest(token_id, F.lit(0)) + 1).cast("int"))


def forward_kl_terms(ls: Column, lt: Column) -> Column:
    return F.zip_with(ls, lt, lambda s, t: F.exp(t) * (t - s))


def reverse_kl_terms(ls: Column, lt: Column) -> Column:
    return F.zip_with(ls, lt, lambda s, t: F.exp(s) * (s - t))


def jsd_terms(ls: Column, lt: Column, beta: float) -> Column:
    """Generalised Jensen-Shannon terms; 0 and 1 are the forward and the reverse divergence."""
    if beta == 0:
        return forward_kl_terms(ls, lt)
    if beta == 1:
        return reverse_kl_terms(ls, lt)
    log_s, log_t = math.log1p(-beta), math.log(beta)

    def term(s: Column, t: Column) -> Column:
        # With m the log of the mixture, both weighted divergences share the part -m * e**m.
        a, b = s + F.lit(log_s), t + F.lit(log_t)
        mixed = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
        from_t, from_s = F.lit(beta) * F.exp(t), F.lit(1 - beta) * F.exp(s)
        return from_t * t + from_s * s - mixed * (from_t + from_s)

    return F.zip_with(ls, lt, term)


def clipped_sum(terms: Column, clip: float | None = None, mode: str = "element") -> Column:
    """Sum over the vocabulary, capped per entry before or per token after it (upper bound only)."""
    if clip is None:
        return total(terms)
    if mode == "element":
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.least(x, F.lit(clip)))
    return F.least(total(terms), F.lit(clip))
