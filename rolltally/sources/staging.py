"""Intermediate tables in the cluster's shared folder.

A staged table is plain Parquet: it outlives lost executors, cuts the lineage, and later
reads keep column pruning and filter pushdown.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_staged: dict[tuple[str, str, str], tuple[str, object]] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder and a cluster an error:
    each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="rolltally-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Derived table ``name`` of the tables under ``source``, written once per application."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _staged:
        df = build()
        path = new_path(spark, name)
        df.write.parquet(path)
        _staged[key] = (path, df.schema)
    path, schema = _staged[key]
    return spark.read.schema(schema).parquet(path)


def staged_path(spark: SparkSession, source: str, name: str) -> str:
    """Where a derived table lies, for jobs that stream from it."""
    return _staged[(spark.sparkContext.applicationId, source, name)][0]
