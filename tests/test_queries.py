"""Every registered query against its SQL on the raw tables, and the shape of plans."""

import re

import pytest

import __spark_entry__ as contract
from rolltally.plans.catalog import QUERIES
from rolltally.plans.checks import CHECKS

duckdb = pytest.importorskip("duckdb")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows_of(columns, names):
    return sorted((tuple(plain(v) for v in r) for r in zip(*[columns[n] for n in names])), key=repr)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    data = cursor.fetchall()
    want = {n: [r[i] for r in data] for i, n in enumerate(names)}
    assert sorted(got.column_names) == sorted(names)
    assert rows_of({n: got[n].to_pylist() for n in names}, sorted(names)) == rows_of(want, sorted(names))
    assert got.num_rows > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_cross_join_or_python(spark, sf_dir, name):
    if name.startswith(("stream_", "write_")):
        pytest.skip("runs its own jobs")
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)
    # Answers that are neither numerals nor words are parsed in Arrow batches; nothing else runs in Python.
    assert set(re.findall(r"ArrowEvalPython \[(\w+)", plan)) <= {"term_keys", "term_keys_eval"}


def test_selection_prunes_before_the_exchange(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["select_shortest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    kinds = [k for line in lines for k in ("WindowGroupLimit", "Exchange", "SortMergeJoin") if line.startswith(k)]
    first = kinds.index("WindowGroupLimit")
    assert kinds[first : first + 4] == ["WindowGroupLimit", "Exchange", "WindowGroupLimit", "SortMergeJoin"]


def test_vote_scan_reads_four_columns(spark, sf_dir):
    plan = QUERIES["majority_vote"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<prompt_id:bigint,rollout_idx:bigint,answer:string,answer_key:string>", plan)
    assert "completion" not in plan


def test_scans_are_cut_by_rows_not_by_cores(spark, sf_dir, tmp_path):
    """A file that a default split holds whole is read in many tasks; smaller settings stay."""
    rows = spark.range(1 << 22).selectExpr("id", "hash(id) AS a", "xxhash64(id) AS b").coalesce(1)
    rows.write.option("parquet.block.size", 1 << 22).parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        QUERIES["head_n"](spark, sf_dir)
        assert spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions() >= 5
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(16 << 20)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        QUERIES["head_n"](spark, sf_dir)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
    finally:
        for name in ("files.minPartitionNum", "files.maxPartitionBytes", "files.openCostInBytes", "adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.unset(f"spark.sql.{name}")


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["prompt_id", "pseudo_label", "consensus_count", "n_rollouts", "vote_correct"]
    assert df.count() == 200
