"""Token-id arrays: cutting, padding and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: label of positions the loss ignores.
IGNORE = -100


def pad_right(ids: Column, length: Column | int, pad: int) -> Column:
    """Array filled up to ``length``; longer arrays stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(ids, fill)


def truncate(ids: Column, length: Column | int) -> Column:
    return F.slice(ids, 1, length)


def pad_truncate(ids: Column, length: int, pad: int) -> Column:
    """Exactly ``length`` entries."""
    return pad_right(truncate(ids, length), length, pad)


def attention_mask(ids: Column, pad: int) -> Column:
    """1 for every id that is not padding."""
    return F.transform(ids, lambda x: F.when(x == pad, 0).otherwise(1))


def label_mask(ids: Column, prompt_length: Column, pad: int) -> Column:
    """Ids with the prompt's true length and all padding set to the ignored label."""
    return F.transform(ids, lambda x, i: F.when((i < prompt_length) | (x == pad), IGNORE).otherwise(x))


def prompt_limit(max_length: int | None, max_tokens: int) -> int | None:
    """Room left for the prompt, at least one token; None means unlimited."""
    return max(1, max_length - max_tokens) if max_length else None


def prompt_budget(ids: Column, max_length: int | None, max_tokens: int) -> Column:
    limit = prompt_limit(max_length, max_tokens)
    return truncate(ids, limit) if limit else ids
