"""Step logs: moving averages, snapshots, windowed means, step times, last rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.operators.ordering import affine_carry, first_rows, running

BLOCK_ROWS = 4096


def _block(step: str, rows: int) -> Column:
    return F.floor(F.col(step) / rows).cast("bigint")


def ema(df: DataFrame, key: str, step: str, value: str, decay: float = 0.995, block_rows: int | None = None) -> DataFrame:
    """Exponential moving average per key in step order; the first value starts it.

    The average is linear, so a block of steps needs only what came in: ``e = decay**n * carried + own part``.
    The own part is a window over one block; blocks are short enough for ``decay**-n`` to stay in range. Carried
    values come from one affine map per block, combined in levels, and only keys longer than one block have any.
    """
    if not 0 <= decay < 1:
        raise ValueError("decay must be in [0, 1)")
    if decay == 0:
        return df.withColumn("ema", F.col(value).cast("double"))
    rows = block_rows or max(1, min(BLOCK_ROWS, int(230 / -math.log(decay))))
    x = F.col(value).cast("double")
    inside = Window.partitionBy(key, "_b").orderBy(step)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = F.sum((1 - decay) * x * F.pow(F.lit(decay), -F.col("_i"))).over(up_to)
    local = (
        df.withColumn("_b", _block(step, rows))
        .withColumn("_i", F.row_number().over(inside) - 1)
        .withColumn("_own", scaled * F.pow(F.lit(decay), F.col("_i")))
        .withColumn("_x0", F.first(x).over(up_to))
    )
    blocks = local.groupBy(key, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_own", "_i").alias("_out"), F.min_by("_x0", "_i").alias("_x0")
    )
    first = blocks.groupBy(key).agg(F.min_by("_x0", "_b").alias("_start"), F.count(F.lit(1)).alias("_blocks"))
    long = blocks.join(first.where("_blocks > 1"), key)
    carried = affine_carry(long, key, "_b", F.pow(F.lit(decay), F.col("_n")), F.col("_out"), F.col("_start")).withColumnRenamed("_carried", "_in")
    joined = local.join(first.select(key, "_start"), key).join(carried, [key, "_b"], "left")
    came_in = F.coalesce(F.col("_in"), F.col("_start"))
    return joined.withColumn("ema", came_in * F.pow(F.lit(decay), F.col("_i") + 1) + F.col("_own")).select(*df.columns, "ema")


def snapshot_asof(df: DataFrame, key: str, step: str, value: str, every: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Value of the latest snapshot (steps divisible by ``every``) at or before each step, frozen in between."""
    taken = F.when(F.col(step) % every == 0, F.struct(F.col(step).alias("s"), F.col(value).alias("v")))
    carried = running(df, [key], [F.col(step)], _block(step, block_rows), {"_snap": ("max", taken)})
    return carried.withColumn("snapshot", F.col("_snap.v")).drop("_snap")


def step_time(df: DataFrame, key: str, step: str, ts: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Seconds since the key's previous step; null at the first."""
    seen = F.struct(F.col(step).alias("s"), F.col(ts).alias("t"))
    prior = running(df, [key], [F.col(step)], _block(step, block_rows), {"_prev": ("max", seen)}, include_current=False)
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev.t").cast("timestamp"))
    return prior.withColumn("step_seconds", micros / F.lit(1e6)).drop("_prev")


def metric_window_mean(log: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Mean of each metric per logging window of ``every`` steps."""
    window = F.floor((F.col(step) - 1) / every).cast("bigint")
    return log.groupBy("name", window.alias("log_window")).agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_values")
    )


def on_off_policy_loss(log: DataFrame, every: int, accumulation: int, step: str = "step") -> DataFrame:
    """Loss per step-equivalent of the on-policy and off-policy micro-steps of a window; null when it has none."""
    share = 1.0 / max(1, accumulation)

    def mean(side: Column) -> Column:
        weight = F.sum(F.when(side, F.lit(share)))
        return F.bround(F.sum(F.when(side, F.col("loss"))) / weight, 4)

    window = F.floor((F.col(step) - 1) / every).cast("bigint")
    return log.groupBy(window.alias("log_window")).agg(
        mean(F.col("on_policy")).alias("on_policy_loss"), mean(~F.col("on_policy")).alias("off_policy_loss")
    )


def last_rows(log: DataFrame, newest_first: list[Column], n: int) -> DataFrame:
    """Last ``n`` log rows."""
    return first_rows(log, newest_first, n)
