"""Tables written to the cluster's shared folder, and sums along an order of any length."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window task holds at most on average, and bits by which a level of buckets widens.
BUCKET_ROWS = 4096
FAN_BITS = 12

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="llm-")
    return _own[app]


def store(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a reader, of the same session if no other is given: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def bucket_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Leading bits of a hash-random key that cut ``rows`` rows into buckets of about ``bucket_rows``."""
    return max(0, (max(rows, 1) - 1) // bucket_rows).bit_length()


def before(sums: DataFrame, keys: list[str], bucket: str, bits: int, totals: list[str]) -> DataFrame:
    """Add ``<total>_before`` to one-row-per-bucket ``sums``: what smaller buckets of the same keys hold.

    Buckets are integers below 2**bits. Levels of 2**12 buckets keep every window small, however many buckets there are.
    """
    def window(*by: str | Column):
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)

    if bits <= FAN_BITS:
        w = window(*keys)
        return sums.select("*", *[F.coalesce(F.sum(t).over(w), F.lit(0)).alias(f"{t}_before") for t in totals])
    high = f"{bucket}_high"
    low = sums.withColumn(high, F.shiftright(bucket, FAN_BITS))
    upper = low.groupBy(*keys, high).agg(*[F.sum(t).alias(t) for t in totals])
    upper = before(upper, keys, high, bits - FAN_BITS, totals).drop(*totals)
    upper = upper.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(high).alias(f"__{high}"),
                         *[F.col(f"{t}_before").alias(f"__{t}") for t in totals])
    on = [low[k].eqNullSafe(upper[f"__{k}"]) for k in keys] + [low[high] == upper[f"__{high}"]]
    joined = low.join(upper, on)
    w = window(*keys, high)
    return joined.select(
        *sums.columns,
        *[(F.coalesce(F.sum(t).over(w), F.lit(0)) + F.col(f"__{t}")).alias(f"{t}_before") for t in totals],
    )
