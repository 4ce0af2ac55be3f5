"""Problem sets and benchmark sets under one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.functions.answers import ground_truth_or_solution
from rolltally.operators.ordering import numbered_all
from rolltally.sources.staging import stage

# Name -> split, problem field, answer field, id field. Without an answer field the
# answer is the boxed one of "solution"; without an id field problems are numbered.
BENCHMARKS = {
    "math500": ("test", "problem", None, None),
    "amo-bench": ("test", "prompt", "answer", "question_id"),
    "minerva": ("test", "question", "answer", "id"),
    "amc23": ("test", "question", "answer", "id"),
    "aime24": ("train", "problem", "answer", "id"),
    "aime25": ("train", "problem", "answer", "problem_idx"),
    "aime26": ("train", "problem", "answer", "problem_idx"),
    "hmmt25": ("train", "problem", "answer", "problem_idx"),
    "hmmt26": ("train", "problem", "answer", "problem_idx"),
    "brumo25": ("train", "problem", "answer", "problem_idx"),
}

# Accepted field names, first present wins.
PROBLEM_FIELDS = ["Question", "question", "problem", "prompt"]
ANSWER_FIELDS = ["Answer", "answer"]


def read_problems(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A problem set from Parquet or JSON lines; give a schema for JSON to save the inference scan."""
    if fmt not in ("parquet", "json"):
        raise ValueError("problem sets are read from parquet or json")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def _present(df: DataFrame, names: list[str]) -> str | None:
    """First of ``names`` the table has; exact case, because ``Answer`` and ``answer`` may both exist."""
    return next((n for n in names if n in df.columns), None)


def normalize_fields(df: DataFrame, keep: list[str] = []) -> DataFrame:
    """``problem``, ``answer`` (string or null), ``solution`` when there is one; other columns are dropped.

    The first field that is *present* is used, also where its value is null.
    """
    problem = _present(df, PROBLEM_FIELDS)
    if problem is None:
        raise ValueError(f"no problem field in {df.columns}")
    answer = _present(df, ANSWER_FIELDS)
    at = {name: f"_{i}" for i, name in enumerate(df.columns)}
    rows = df.toDF(*at.values())  # by position: names that differ in case only are one name to Spark
    columns: list[Column] = [F.col(at[k]).alias(k) for k in keep] + [F.col(at[problem]).alias("problem")]
    columns.append((F.col(at[answer]).cast("string") if answer else F.lit(None).cast("string")).alias("answer"))
    if "solution" in at:
        columns.append(F.col(at["solution"]).alias("solution"))
    return rows.select(*columns)


def map_benchmark(df: DataFrame, name: str) -> DataFrame:
    """Rows of one benchmark as ``dataset, problem_id, problem, ground_truth``."""
    key = name.lower()
    if key not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name!r}; known: {', '.join(BENCHMARKS)}")
    _, problem, answer, ident = BENCHMARKS[key]
    truth = F.col(answer).cast("string") if answer else ground_truth_or_solution(F.col("solution"))
    if ident and ident in df.columns:
        problem_id = F.col(ident)
    else:
        # A set without ids is numbered in the order of its problems' texts, nulls last; equal texts are told apart by their number only.
        order = [F.col(problem).asc_nulls_last(), F.col("_place")]
        df = numbered_all(df.withColumn("_place", F.monotonically_increasing_id()), order, "_number")
        problem_id = F.col("_number")
    return df.select(
        F.lit(key).alias("dataset"), problem_id.cast("string").alias("problem_id"), F.col(problem).alias("problem"), truth.alias("ground_truth")
    )


def read_benchmark(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Benchmark ``name`` from ``<root>/<name>/<split>``."""
    if name.lower() not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name!r}; known: {', '.join(BENCHMARKS)}")
    split = BENCHMARKS[name.lower()][0]
    return map_benchmark(spark.read.format(fmt).load(f"{root}/{name.lower()}/{split}"), name)


def union_benchmarks(tables: dict[str, DataFrame]) -> DataFrame:
    """Several benchmarks in one table."""
    merged = None
    for name, df in tables.items():
        mapped = map_benchmark(df, name)
        merged = mapped if merged is None else merged.unionByName(mapped)
    return merged


def map_prompts(df: DataFrame, mapping: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row mapper that replaces all columns, e.g. fields to prompt and answer."""
    return df.transform(mapping)
