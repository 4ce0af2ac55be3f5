"""The pipeline: its stages in order, each on what its predecessor kept."""


import corpus_pipeline
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "substring_dedup", "source_mix", "packing"]


def test_stages_on_planted_documents(spark, sf_dir):
    from rolltally.llm.store import store

    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    clean = table.orderBy("doc_id").first()
    passage = " ".join(f"q{i}" for i in range(60))
    planted = [
        (10_001, clean.text, clean.lang, clean.source, 1), (10_002, None, "en", "src0", 0), (10_003, "12 34 --", "en", "src0", 0),
        (10_004, "alpha beta " + passage, "en", "src1", 0), (10_005, "gamma " + " ".join(f"g{i}" for i in range(60)) + " of the " + passage, "en", "src1", 0),
    ]
    docs = store(table.unionByName(spark.createDataFrame(planted, table.schema)), "test-docs")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in out.where("doc_id > 10000").collect()}
            assert "q5 q6" in texts[10_004] and "q5 q6" not in texts[10_005] and "gamma" in texts[10_005]
        docs = out
    assert clean.doc_id in seen["language_id"] and not seen["language_id"] & {10_002, 10_003}
    assert 10_001 not in seen["minhash_dedup"] and {clean.doc_id, 10_004, 10_005} <= seen["minhash_dedup"]
    assert seen["packing"] == seen["source_mix"] <= seen["substring_dedup"]


def test_run_on_an_empty_table(spark, tmp_path):
    schema = T.StructType.fromDDL(SCHEMA) if hasattr(T.StructType, "fromDDL") else None
    empty = spark.createDataFrame([], schema or SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
