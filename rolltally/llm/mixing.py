"""Mixing sources to target weights: hash-random keys, order within the source, distributed prefix sums, exact cut.

Every row gets a random but repeatable key (md5 of its id). Per source the keys order the rows; sums per key bucket, carried
over the buckets, and a window inside each bucket give every row the words that stand before it. A source of S words with
target T is taken floor(T / S) times whole; the rest T - floor(T / S) * S is cut at the exact word in key order.

Defined cases: a null text has 0 words; a null source is a source of its own, ordered last; an empty table gives no rows;
repeated rows (same id, source and text) share what is taken of them alike; columns other than id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolltally.llm.store import before, bucket_bits, store

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: Shares by rank of the source's name, repeated for further sources.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` -> with ``target``: shares of the total by weight, none above max_epochs * source_size.

    Sources in order of cap per weight: each one is capped while the level that the rest would get reaches its cap. There
    is one row per source here, not per document.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    common = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))).over(every)["level"]
    return levelled.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * common).alias("target")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per distinct (id, source, text): ``doc_id, source, text_hash, copies, size, source_size, target, taken`` (of each copy)."""
    sized = docs.select(
        docs[doc_id].alias("doc_id"), docs[source].alias("source"), text_hash(docs[text]).alias("text_hash"), n_words(docs[text]).alias("size")
    )
    rows = sized.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = store(
        rows.withColumn("words", F.col("size") * F.col("copies"))
        .withColumn("key", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")),
        "mix-rows",
    )
    bits = bucket_bits(rows.count())
    bucket = F.shiftright("key", KEY_BITS - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sums = store(rows.groupBy("source", "bucket").agg(F.sum("words").alias("words")), "mix-sums")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    carried = before(sums, ["source"], "bucket", bits, ["words"])
    plan = carried.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(
        F.col("c.source").alias("p_source"), F.col("c.bucket").alias("p_bucket"), "words_before", "source_size", "target"
    )
    joined = rows.join(plan, rows.source.eqNullSafe(plan.p_source) & (rows.bucket == plan.p_bucket))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long") - F.col("start")
    part = F.least(F.col("words"), F.greatest(F.lit(0).cast("long"), left))
    return (
        joined.withColumn("start", F.col("words_before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .withColumn("full", full)
        .select(
            "doc_id", "source", "text_hash", "copies", "size", "source_size", "target",
            (F.col("full") * F.col("size") + F.floor(part / F.col("copies")).cast("long")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document once for every whole epoch, and the document at the cut once
    more with only the words that were still wanted (joined by one space). Documents of which nothing is taken are absent."""
    chosen = mix(docs, weights, max_epochs).select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("text_hash").alias("m_hash"), "size", "taken"
    ).where((F.col("taken") > 0) | (F.col("size") == 0))
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("d_id"), docs["source"].alias("d_source"), text_hash(docs["text"]).alias("d_hash")
    )
    rows = rows.join(chosen, F.col("d_id").eqNullSafe(F.col("m_id")) & F.col("d_source").eqNullSafe(F.col("m_source")) & (F.col("d_hash") == F.col("m_hash")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    epochs = F.array_repeat(F.lit(0), whole)
    rows = rows.select("row", F.explode(F.when(rest > 0, F.concat(epochs, F.array(rest))).otherwise(epochs)).alias("cut"))
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("cut") > 0, F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ")).otherwise(F.col("row.text"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("cut") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[c.alias(n) for n, c in out.items()])


def op4_source_mix(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`mix`, one row per input row."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies").select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "doc_id", "size", "source_size", "target", "taken"
    ).drop("copy")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, ([5.0::DOUBLE, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         (3 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN cap / weight <= level THEN cap
              ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) END AS target FROM l
), c AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(full_epochs * size + least(size, greatest(0, floor(target - full_epochs * source_size) - start)) AS BIGINT) AS taken
FROM c
"""
