"""Ordered computations inside groups of any size: running totals, numbering, carry-forward.

A window over a whole group runs in one task, which a group holding a third of all rows does
not survive. Here a group is cut into blocks that follow its order. Each block is summarised with
an ordinary combinable aggregate, the summaries (one row per block) are accumulated, and the
window itself only ever covers one block.

``block`` must be a non-decreasing function of the order. Group keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.sources.staging import stage

_BLOCK = "_block"
HOT_ROWS = 1 << 20

_MERGE = {"sum": F.sum, "max": F.max, "count": F.sum}
_FIRST = {"sum": F.sum, "max": F.max, "count": F.count}


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "max":
        return F.greatest(before, here)
    return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))


def running(
    df: DataFrame,
    group: list[str],
    order: list[Column | str],
    block: Column,
    measures: dict[str, tuple[str, Column]],
    include_current: bool = True,
) -> DataFrame:
    """Add running totals. ``measures``: new column -> (``sum`` | ``max`` | ``count``, expression).

    ``max`` also takes structs ordered by their first field. It then carries the latest
    non-null struct forward, so its expression must be ordered like the rows.
    """
    tagged = df.withColumn(_BLOCK, block)
    earlier = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per_block = tagged.groupBy(*group, _BLOCK).agg(
        *[_FIRST[kind](expr).alias(f"_in_{name}") for name, (kind, expr) in measures.items()]
    )
    carried = per_block.select(
        *group, _BLOCK, *[_MERGE[kind](f"_in_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in measures.items()]
    )
    inside = (
        Window.partitionBy(*group, _BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    joined = tagged.join(carried, [*group, _BLOCK], "left")
    for name, (kind, expr) in measures.items():
        joined = joined.withColumn(name, _combine(kind, F.col(f"_c_{name}"), _FIRST[kind](expr).over(inside)))
    return joined.drop(_BLOCK, *[f"_c_{name}" for name in measures])


#: Children that one node of a carry tree has at most.
FAN = 256


def affine_carry(blocks: DataFrame, key: str, block: str, factor: Column, shift: Column, start: Column, fan: int = FAN) -> DataFrame:
    """``key, block, _carried``: the value that reaches each block if every block makes ``factor * x + shift`` of an ``x``, and ``start`` reaches the first.

    ``blocks``: one row per (key, whole number ``block``). Maps of ``fan`` neighbours are composed to one, level by level, until a key has a single
    node; then values go down again. Every group holds ``fan`` rows at most, whatever the length of a key. ``start`` is one value per key.
    """
    node = blocks.select(F.col(key).alias("_key"), F.col(block).cast("bigint").alias("_at"), factor.cast("double").alias("f"), shift.cast("double").alias("s"))
    starts = blocks.groupBy(F.col(key).alias("_key")).agg(F.min(start).cast("double").alias("_carried"))
    ends = blocks.agg(F.min(F.col(block)).alias("low"), F.max(F.col(block)).alias("high")).first()
    low, high = (int(ends["low"] or 0), int(ends["high"] or 0))
    levels: list[DataFrame] = []
    while True:
        kids = F.array_sort(F.collect_list(F.struct("_at", "f", "s")))
        node = node.groupBy("_key", F.floor(F.col("_at") / fan).cast("bigint").alias("_up")).agg(kids.alias("kids"))
        low, high = low // fan, high // fan
        if low == high:
            levels.append(node)
            break
        node = stage(node, "carry")  # used on the way up and on the way down
        levels.append(node)
        both = F.aggregate(
            "kids", F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("s")),
            lambda m, k: F.struct((k["f"] * m["f"]).alias("f"), (k["f"] * m["s"] + k["s"]).alias("s")),
        )
        node = node.select("_key", F.col("_up").alias("_at"), both.alias("m")).select("_key", "_at", "m.f", "m.s")
    reached = starts.withColumn("_up", F.lit(low).cast("bigint"))
    none = F.array().cast("array<struct<at:bigint,x:double>>")
    for level in reversed(levels):
        down = F.aggregate(
            "kids", F.struct(F.col("_carried").alias("x"), none.alias("out")),
            lambda m, k: F.struct((k["f"] * m["x"] + k["s"]).alias("x"), F.concat(m["out"], F.array(F.struct(k["_at"].alias("at"), m["x"].alias("x")))).alias("out")),
        )
        reached = level.join(reached, ["_key", "_up"]).select("_key", F.explode(down["out"]).alias("o")).select("_key", F.col("o.at").alias("_up"), F.col("o.x").alias("_carried"))
    return reached.select(F.col("_key").alias(key), F.col("_up").alias(block), "_carried")


#: Buckets that rows are counted in before their groups are.
_BUCKETS = 1 << 16


def hot_groups(df: DataFrame, group: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups of more than ``hot_rows`` rows: at most (rows / hot_rows) of them.

    Rows are counted by a bucket of their key first, which every map task reduces to a short table; only rows of buckets that are large
    enough to hold such a group are counted by group.
    """
    tagged = df.select(*group, F.pmod(F.hash(*group), F.lit(_BUCKETS)).alias("_bucket"))
    count = F.count(F.lit(1)).alias("_rows")
    full = tagged.groupBy("_bucket").agg(count).where(F.col("_rows") > hot_rows).select("_bucket")
    return tagged.join(F.broadcast(full), "_bucket", "left_semi").groupBy(*group).agg(count).where(F.col("_rows") > hot_rows)


def numbered(
    df: DataFrame,
    group: list[str],
    order: list[Column | str],
    block: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row in its group's order; ``order`` must be total.

    Only groups above ``hot_rows`` are cut into blocks. Without any, all costs one exchange by group, which a join by group after it uses
    as well. The list of hot groups cannot be longer than the row count over ``hot_rows``, so it is broadcast.
    """
    hot = hot_groups(df, group, hot_rows).select(*group, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
        return df.withColumn(name, place.cast("bigint"))
    hot = F.broadcast(stage(hot, "hot-groups"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(f"b{i}") for i, _ in enumerate(_fields(block))])
    parts = F.struct(*[b.cast("bigint").alias(f"b{i}") for i, b in enumerate(_fields(block))])
    tagged = df.join(hot, group, "left").withColumn(
        _BLOCK, F.when(F.col("_hot"), parts).otherwise(none)
    )
    earlier = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tagged.where(F.col("_hot"))
        .groupBy(*group, _BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, _BLOCK, F.sum("_n").over(earlier).alias("_before"))
    )
    inside = Window.partitionBy(*group, _BLOCK).orderBy(*order)
    return (
        tagged.join(carried, [*group, _BLOCK], "left")
        .withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.row_number().over(inside) - 1)
        .drop(_BLOCK, "_before", "_hot")
    )


def numbered_all(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Add the 0-based position in the whole table; ``order`` must be total, nulls come first.

    The order is cut into ranges at splitters that Spark samples, so neither the spread of the keys nor gaps between them matter. The ranges
    are staged, then numbered side by side; only their sizes, one row per shuffle partition, meet in one task.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn(_BLOCK, F.spark_partition_id()), "ranges")
    earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    carried = sizes.select(_BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(_BLOCK).orderBy(*order)
    return (
        ranged.join(carried, _BLOCK)
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop(_BLOCK, "_before")
    )


#: Rows that one task ranks or merges at most.
MOST_IN_A_TASK = 1 << 16
_BINS = 1024


def mark_smallest(
    df: DataFrame, group: list[str], keys: list[Column], k: Column, name: str, most: int = MOST_IN_A_TASK
) -> DataFrame:
    """Add ``name``: whether a row is among the ``k`` smallest of its group by ``keys`` (numbers, in total order; ``k`` is an aggregate).

    A group's cut lies in a zone of key values, at first all of them. While a zone holds more than ``most`` rows, a histogram of the first key that still varies in it shows the bin
    of the cut, which becomes the zone. Rows below it are kept, rows above it are not, and only those in it are ranked.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    tagged = df.withColumns({n: key.cast("double") for n, key in zip(names, keys, strict=True)})
    ends = [f(n).alias(f"{side}{n}") for n in names for f, side in ((F.min, "_lo"), (F.max, "_hi"))]
    bounds = [f"{side}{n}" for n in names for side in ("_lo", "_hi")]
    same = [F.col(f"_g{i}") for i in range(len(group))]
    by_group = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    zones = stage(tagged.groupBy(*by_group).agg(k.cast("bigint").alias("_k"), F.count(F.lit(1)).alias("_n"), *ends), "zones")

    def meet(rows: DataFrame, zone: DataFrame) -> DataFrame:
        on = [F.col(g).eqNullSafe(c) for g, c in zip(group, same, strict=True)]
        return rows.join(zone, on)

    def side() -> Column:
        """-1 below the zone, 1 above it, else 0: the first key on which a row isn't where the zone is."""
        out = F.lit(0)
        for n in reversed(names):
            out = F.when(F.col(n) < F.col(f"_lo{n}"), -1).when(F.col(n) > F.col(f"_hi{n}"), 1).otherwise(out)
        return out

    while True:
        wide = F.col("_n") > most
        varied = F.lit(False)
        for n in names:
            varied = varied | (F.col(f"_lo{n}") < F.col(f"_hi{n}"))
        open_ = (F.col("_k") > 0) & (F.col("_k") < F.col("_n")) & varied
        if zones.where(wide & open_).isEmpty():
            break
        inside = meet(tagged, zones.where(wide & open_)).where(side() == 0)
        share = F.lit(None).cast("double")
        for n in reversed(names):
            lo, hi = F.col(f"_lo{n}"), F.col(f"_hi{n}")
            share = F.when(lo < hi, (F.col(n) - lo) / (hi - lo)).otherwise(share)
        bins = inside.groupBy(*same, F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).alias("_bin")).agg(F.first("_k").alias("_k"), F.count(F.lit(1)).alias("_n"), *ends)
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*same).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = bins.withColumn("_before", before).where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
        narrowed = cut.withColumn("_k", F.col("_k") - F.col("_before")).select(*same, "_k", "_n", *bounds)
        zones = stage(zones.where(~(wide & open_)).unionByName(narrowed), "zones")
    placed = meet(tagged, zones).withColumn("_side", side())
    whole = (F.col("_side") != 0) | (F.col("_k") <= 0) | (F.col("_k") >= F.col("_n"))
    # A group whose every row is kept or dropped needs no ranks either.
    clear = placed.where(whole).withColumn(name, (F.col("_side") < 0) | ((F.col("_side") == 0) & (F.col("_k") >= F.col("_n"))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*names))
    ranked = placed.where(~whole).withColumn(name, rank <= F.col("_k"))
    return clear.unionByName(ranked).select(*df.columns, name)


def first_rows(df: DataFrame, order: list[Column | str], n: int, most: int = MOST_IN_A_TASK) -> DataFrame:
    """The first ``n`` rows of a total order. A few are merged in one task; more are cut from sampled ranges, each of which is ordered by itself."""
    if n <= most:
        return df.orderBy(*order).limit(n)
    return numbered_all(df, order, "_place").where(F.col("_place") < n).drop("_place")


def _fields(block: Column | list[Column]) -> list[Column]:
    return block if isinstance(block, list) else [block]


def top_rows(df: DataFrame, group: list[str], order: list[Column | str], limit: int, name: str) -> DataFrame:
    """First ``limit`` rows of every group with their 1-based rank.

    The rank filter has a constant bound, so Spark prunes to ``limit`` rows per group inside every
    map task before the exchange (WindowGroupLimit): a hot group arrives already cut down. The session
    setting ``requireAllClusterKeysForDistribution`` keeps that exchange after a join on part of the group key.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
