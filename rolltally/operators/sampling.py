"""Dedup, seeded sampling and splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.operators.ordering import first_rows, top_rows


def seeded_hash(keys: list[str], seed: int) -> Column:
    """Hex digest of the key under a seed: same value on every run, engine and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def dedup(df: DataFrame, keys: list[str], first_by: list[str]) -> DataFrame:
    """First row per key. The rank-1 filter is applied inside each map task, so copies do not travel."""
    return top_rows(df, keys, first_by, 1, "_rank").drop("_rank")


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all when there are fewer) in the order of their seeded hash."""
    hashed = df.withColumn("_hash", seeded_hash(keys, seed))
    return first_rows(hashed, ["_hash", *keys], n).drop("_hash")


def train_eval_split(df: DataFrame, keys: list[str], test_size: float = 0.007, seed: int = 42) -> DataFrame:
    """Add ``split``: a row is ``test`` when its seeded hash falls into the given share."""
    limit = format(min(int(test_size * 16**8), 16**8 - 1), "08x")
    in_test = F.substring(seeded_hash(keys, seed), 1, 8) < limit
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def shard_interleaved(df: DataFrame, row_index: str, n: int) -> DataFrame:
    """Shard ``r`` of ``n`` holds rows r, r+n, r+2n, ..."""
    return df.withColumn("shard", F.pmod(F.col(row_index), F.lit(n)).cast("bigint"))


def head_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of an explicit order."""
    return first_rows(df, order, n)


def merge_batches(batches: list[DataFrame], order: list[str], total: int) -> DataFrame:
    """Batches one after the other, cut to ``total`` rows."""
    merged = None
    for number, batch in enumerate(batches):
        tagged = batch.withColumn("batch_no", F.lit(number))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return first_rows(merged, ["batch_no", *order], total)
