"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolltally.llm import (
    ann, embedding_dedup, html_extract, language_id, license_scan, minhash_dedup, mixing, packing, periodic_runs, pii, role_repair, sharding, substring_dedup,
)
from rolltally.plans.session import configure


def _table(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return op(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": _table("documents", language_id.op1_language),
    "op2_licenses": _table("documents", license_scan.op2_licenses),
    "op3_substring_dedup": _table("documents", substring_dedup.op3_substring_dedup),
    "op4_source_mix": _table("documents", mixing.op4_source_mix),
    "op5_embedding_dedup": _table("embeddings", embedding_dedup.op5_embedding_dedup),
    "op6_packing": _table("documents", packing.op6_packing),
    "op7_minhash": _table("documents", minhash_dedup.op7_minhash),
    "op8_shards": _table("documents", sharding.op8_shards),
    "op9_neighbours": _table("embeddings", ann.op9_neighbours),
    "op10_html": _table("pages", html_extract.op10_html),
    "op11_pii": _table("documents", pii.op11_pii),
    "op12_runs": _table("documents", periodic_runs.op12_runs),
    "op13_conversations": _table("conversations", role_repair.op13_conversations),
}

ORACLES: dict[str, str] = {
    "op2_licenses": license_scan.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_source_mix": mixing.ORACLE_SQL,
    "op5_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op7_minhash": minhash_dedup.ORACLE_SQL,
    "op13_conversations": role_repair.ORACLE_SQL,
}
