"""Sharding by sampled splitters: shards of near equal bytes.

A record's key has the high bits of its text's hash and, below them, bits of its id's hash, so that equal texts lie side by side and a
text that a third of all rows share still spreads over many keys. Splitters are the quantiles of a sample in which a record
appears with a probability in proportion to its size. The splitters cut the keys into ranges; a range with too many rows is cut further
at quantiles of its own rows. Exact sums over the ranges, carried along their order, and a window inside each range give
every record its first byte in key order, and with it shard and slot: sizes differ by about one record.

Defined cases: a null text has size 1 and checksum 0; an empty table gives no rows; repeated rows get slots of their own; columns other than id
and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.llm.store import BUCKET_ROWS, before, store

GROUP_BITS = 44
#: Ranges between splitters (a power of 16), and sampled records per range, on average. They bound what the driver sees.
RANGES = 256
SAMPLED_PER_RANGE = 64
#: Parts that an overfull range is cut into at a time (a power of 2).
PARTS = 64


def record_key(text: Column, doc_id: Column) -> Column:
    low = 64 - GROUP_BITS
    high = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), low), low)
    return high.bitwiseOR(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << low) - 1)))


def splitters(rows: DataFrame, total_bytes: int, ranges: int = RANGES, per_range: int = SAMPLED_PER_RANGE) -> list[int]:
    """Keys that cut ``rows`` (``key``, ``size``) into ranges of about equal bytes; at most ``ranges - 1`` of them.

    The sample holds about ranges * per_range records whatever the input's size; its quantiles come back as one row.
    """
    chance = F.col("size") * (ranges * per_range / max(1, total_bytes))
    uniform = F.pmod(F.xxhash64("key", "doc_id", F.lit("splitter")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(uniform < chance).select("key")
    points = [i / ranges for i in range(1, ranges)]
    row = sample.agg(F.percentile_approx("key", points, 100 * ranges)).first()[0]
    return sorted(set(row or []))


def range_of(key: Column, cuts: list[int], fan: int = 16) -> Column:
    """Number of cuts at or below ``key``, by a coarse and a fine step."""
    if not cuts:
        return F.lit(0)
    parts = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    coarse = sum((F.when(key >= F.lit(p[0]), 1).otherwise(0) for p in parts), F.lit(0))
    table = F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts])
    fine = F.size(F.filter(F.element_at(table, F.greatest(coarse, F.lit(1))), lambda c: c <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * fan + fine)


def subdivided(ranged: DataFrame, bits: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """``ranged`` (``key, range``) with ranges of more than ``2 * bucket_rows`` rows cut at quantiles of their own rows' keys, again and again, and the bits of a range's
    number. A splitter's share counts bytes, a quantile rows, so short texts that many rows share are split as well. What is left is rows with one key: the same text and id."""
    last = None
    while True:
        sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
        wide = sizes.where(F.col("rows") > 2 * bucket_rows)
        widest = wide.agg(F.max("rows")).first()[0]
        if widest is None or widest == last:
            return ranged, bits
        points = [i / PARTS for i in range(1, PARTS)]
        cut = ranged.join(wide.select("range"), "range").groupBy(F.col("range").alias("cut_range")).agg(F.array_distinct(F.percentile_approx("key", points, 100 * PARTS)).alias("cuts"))
        cut = store(cut, "shard-cuts")  # at most rows / bucket_rows rows, so Spark broadcasts it while it is small
        part = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("key"))).cast("long"), F.lit(0).cast("long"))
        ranged = ranged.join(cut, F.col("range") == F.col("cut_range"), "left").withColumn("range", F.col("range") * PARTS + F.when(F.col("cuts").isNull(), 0).otherwise(part)).drop("cut_range", "cuts")
        bits, last = bits + (PARTS - 1).bit_length(), widest


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards are ranges of the key of near equal bytes, slots count from 0 in key order."""
    rows = store(
        docs.select(
            docs[doc_id].alias("doc_id"),
            (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(docs[text].cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            record_key(docs[text], docs[doc_id]).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(rows, total)
    ranged, bits = subdivided(rows.withColumn("range", range_of(F.col("key"), cuts).cast("long")), len(cuts).bit_length(), bucket_rows)
    sums = store(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-sums")
    starts = before(sums, [], "range", bits, ["bytes", "rows"]).select("range", F.col("bytes_before").alias("b"), F.col("rows_before").alias("r"))
    order = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", "size")
    placed = ranged.join(starts, "range").select(
        "doc_id", "size", "text_crc32",
        (F.col("b") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("first_byte"),
        (F.col("r") + F.row_number().over(order) - 1).alias("place"),
    )
    middle = (F.col("first_byte") + F.col("size") / 2) * shards / F.lit(float(max(1, total)))
    placed = store(placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int")).drop("first_byte"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op8_shards(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
