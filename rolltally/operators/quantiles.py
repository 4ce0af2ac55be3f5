"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.operators.ordering import running


def exact_percentiles(df: DataFrame, keys: list[str], values: list[str], q: float, accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated percentile ``q`` of each value column per group, with its minimum.

    One row per group: ``<value>_at`` and ``<value>_min``. All columns are handled in one pass as (group, column, value) rows, and
    groups of every size in the same way. A mergeable sketch brackets the wanted rank, ten times wider than its error bound; values
    below the bracket are only counted, those above it dropped, and equal values are merged before the exchange, so roughly 2 of every 1000
    values are sorted.
    """
    slack = 10.0 / accuracy
    low, high = q - slack, q + slack
    pairs = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(name).alias("_x")) for name in values])
    rows = df.select(*keys, F.inline(pairs)).where(F.col("_x").isNotNull())
    group = [*keys, "_name"]
    ends = F.percentile_approx("_x", F.array(F.lit(max(low, 0.0)), F.lit(min(high, 1.0))), F.lit(accuracy))
    bracket = rows.groupBy(*group).agg(
        F.count("_x").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), ends.alias("_ends")
    )
    few = F.col("_n") * slack < 2  # a bracket this narrow could fall between two ranks
    bracket = bracket.select(
        *group,
        "_n",
        "_min",
        F.when(few | F.lit(low <= 0), F.col("_min")).otherwise(F.col("_ends")[0]).alias("_lo"),
        F.when(few | F.lit(high >= 1), F.col("_max")).otherwise(F.col("_ends")[1]).alias("_hi"),
    )
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    counts = (
        rows.join(bracket, group)
        .where(x <= hi)
        .groupBy(*group, "_n", "_min", "_lo", "_hi", F.when(x >= lo, x).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    slot = F.when(F.col("_v").isNull(), -1).when(hi > lo, F.floor((F.col("_v") - lo) / (hi - lo) * 1024)).otherwise(0)
    ranked = running(counts, group, [F.col("_v").asc_nulls_first()], slot.cast("bigint"), {"_upto": ("sum", F.col("_c"))})
    rank = F.lit(q) * (F.col("_n") - 1)

    def at(position: Column) -> Column:
        reached = F.col("_upto") > position
        missed = F.max(F.when(reached & F.col("_v").isNotNull(), 1)).isNull() | F.max(
            F.when(reached & F.col("_v").isNull(), 1)
        ).isNotNull()
        error = F.raise_error(F.lit("percentile bracket missed its rank")).cast("double")
        return F.when(missed, error).otherwise(F.min(F.when(reached, F.col("_v"))))

    found = (
        ranked.groupBy(*group)
        .agg(
            at(F.floor(rank)).alias("_a"),
            at(F.ceil(rank)).alias("_b"),
            F.first(rank - F.floor(rank)).alias("_w"),
            F.first("_min").alias("_min"),
        )
        .select(*group, "_min", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("_at"))
    )
    one = lambda name, column: F.max(F.when(F.col("_name") == name, F.col(column)))
    return found.groupBy(*keys).agg(
        *[one(name, column).alias(f"{name}{column}") for name in values for column in ("_at", "_min")]
    )
