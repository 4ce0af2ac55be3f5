import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolltally.operators import series
from rolltally.operators.ordering import affine_carry, first_rows, mark_smallest, numbered, numbered_all, running, top_rows
from rolltally.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 6000
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"g": g, "i": rng.permutation(n), "x": rng.normal(size=n), "y": rng.integers(0, 5, n).astype(float)})
    pdf.loc[pdf.g == 3, "x"] = 1.0
    return pdf, spark.createDataFrame(pdf).repartition(9).cache()


@pytest.mark.parametrize("hot_rows", [10, 500, 10**6])
def test_numbered(table, hot_rows):
    pdf, df = table
    got = numbered(df, ["g"], ["i"], F.floor(F.col("i") / 100), "r", hot_rows).toPandas().set_index("i")["r"].sort_index()
    want = (pdf.set_index("i").sort_index().groupby("g").cumcount()).sort_index()
    assert (got == want).all()


def test_numbered_shares_its_exchange_with_a_join(spark, table):
    """Without a hot group, numbering and a join by group after it exchange the rows once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = numbered(table[1], ["g"], ["i"], F.floor(F.col("i") / 100), "r")
        names = spark.range(40).select(F.col("id").alias("g"), F.col("id").cast("string").alias("name"))
        plan = rows.join(names, "g")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # rows, names


@pytest.mark.parametrize("spread", [1, 10**9])
def test_numbered_all(spark, table, spread):
    """Positions, plan and range sizes don't depend on how far apart the keys are."""
    pdf, df = table
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered_all(df.withColumn("i", F.col("i") * spread), ["i"], "r")
        rows = got.toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (rows.r * spread == rows.i).all() and len(rows) == len(pdf)
    sizes = [spark.read.parquet(f).count() for f in got.inputFiles()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(pdf) / 8  # one file per range, as many ranges as shuffle partitions


def test_numbered_all_keeps_nulls(spark):
    df = spark.createDataFrame([(None if i < 1 else i,) for i in range(6)], "id long")
    assert sorted((r.id or 0, r.n) for r in numbered_all(df, ["id"], "n").collect()) == [(i, i) for i in range(6)]


@pytest.mark.parametrize("fan", [16, 256])
def test_affine_carry(spark, fan):
    """Values carried through maps of any number of levels; block numbers may have gaps and begin below zero."""
    rng = np.random.default_rng(3)
    at = {1: range(500), 2: sorted(rng.choice(10**9, 40, replace=False).tolist()), 3: [-7], 4: range(-20, 21)}
    rows = [(k, int(b), float(rng.uniform(0, 1.2)), float(rng.normal()), float(k)) for k, bs in at.items() for b in bs]
    df = spark.createDataFrame(rows, "k long, b long, f double, s double, x double").repartition(4)
    got = {(r.k, r.b): r._carried for r in affine_carry(df, "k", "b", F.col("f"), F.col("s"), F.col("x"), fan).collect()}
    assert len(got) == len(rows)
    value = {}
    for k, b, f, s, x in rows:
        value.setdefault(k, x)
        assert got[k, b] == pytest.approx(value[k], rel=1e-9, abs=1e-12)
        value[k] = f * value[k] + s


def test_affine_carry_groups_are_bounded(spark):
    """One key with all rows: no task of the tree sees more than the fan-out, and nothing runs in Python."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("step"), F.col("id").cast("double").alias("x"))
    out = series.ema(df, "k", "step", "x", 0.9, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    e = 0.0
    got = {r.step: r.ema for r in out.collect()}
    for i in range(5000):
        e = i if i == 0 else 0.9 * e + 0.1 * i
        assert got[i] == pytest.approx(e, rel=1e-9)


@pytest.mark.parametrize("include", [True, False])
def test_running(table, include):
    pdf, df = table
    got = running(
        df, ["g"], ["i"], F.floor(F.col("i") / 64).cast("bigint"),
        {"n": ("count", F.lit(1)), "s": ("sum", F.col("y")), "m": ("max", F.when(F.col("y") > 2, F.struct("i", "y")))}, include,
    ).toPandas().set_index("i").sort_index()
    for _, part in pdf.sort_values("i").groupby("g"):
        seen, total, last = 0, 0.0, None
        for row in part.itertuples():
            if include:
                seen, total, last = seen + 1, total + row.y, row if row.y > 2 else last
            r = got.loc[row.i]
            assert (r.n, r.s) == (seen, total)
            assert (r.m.i, r.m.y) == (last.i, last.y) if last else r.m is None
            if not include:
                seen, total, last = seen + 1, total + row.y, row if row.y > 2 else last


@pytest.mark.parametrize("q", [0.0, 0.5, 0.98, 1.0])
def test_percentiles(table, q):
    pdf, df = table
    want = pdf.groupby("g").agg(x=("x", lambda s: s.quantile(q)), y=("y", lambda s: s.quantile(q)), low=("x", "min"))
    for accuracy in (1000, 10000):
        got = exact_percentiles(df, ["g"], ["x", "y"], q, accuracy)
        got = got.toPandas().set_index("g").sort_index()
        assert np.allclose(got.x_at, want.x) and np.allclose(got.y_at, want.y) and np.allclose(got.x_min, want.low)


@pytest.mark.parametrize("most", [1, 20, 10**6])
def test_mark_smallest(table, most):
    """Shares of groups with ties in the first key, down to zones of a single row."""
    pdf, df = table
    k = F.floor(F.count(F.lit(1)) * 0.3)
    got = mark_smallest(df, ["g"], [F.col("y"), F.col("i")], k, "kept", most).toPandas()
    ordered = pdf.sort_values(["g", "y", "i"])
    place, size = ordered.groupby("g").cumcount(), ordered.groupby("g").i.transform("size")
    assert set(got[got.kept].i) == set(ordered[place < (size * 0.3).astype(int)].i) and len(got) == len(pdf)
    some = mark_smallest(df, ["g"], [-F.col("x"), F.col("i")], F.when(F.col("g") == 3, 0).otherwise(10**9) if most == 0 else F.lit(4), "kept", most).toPandas()
    want = pdf.sort_values(["g", "x", "i"], ascending=[True, False, True]).groupby("g").head(4)
    assert set(some[some.kept].i) == set(want.i)


def test_first_rows(table):
    pdf, df = table
    for n in (0, 7, 3000, 10**6):
        for most in (5, 10**6):
            got = first_rows(df, [F.col("y").desc(), "i"], n, most).toPandas()
            want = pdf.sort_values(["y", "i"], ascending=[False, True]).head(n)
            assert set(got.i) == set(want.i) and len(got) == len(want)


def test_top_rows(table):
    pdf, df = table
    got = top_rows(df, ["g"], [F.col("x").desc(), F.col("i")], 3, "r").toPandas()
    want = pdf.sort_values(["g", "x", "i"], ascending=[True, False, True]).groupby("g").head(3)
    assert set(got.i) == set(want.i)


@pytest.mark.parametrize("decay,rows", [(0.995, None), (0.9, 7), (0.5, 3), (0.05, None), (0.0, None)])
def test_ema(spark, decay, rows):
    rng = np.random.default_rng(2)
    data = [(k, s, float(v)) for k, n in ((1, 500), (2, 3), (3, 1)) for s, v in zip(range(1, n + 1), rng.normal(size=n))]
    df = spark.createDataFrame(data, "k long, step long, x double").repartition(5)
    got = {(r.k, r.step): r.ema for r in series.ema(df, "k", "step", "x", decay, rows).collect()}
    value = {}
    for k, s, x in data:
        value[k] = x if k not in value else decay * value[k] + (1 - decay) * x
        assert got[k, s] == pytest.approx(value[k], rel=1e-9, abs=1e-12)
    assert len(got) == len(data)


def test_snapshot_and_step_time(spark):
    data = [(1, s, float(s * s), f"2024-01-01 00:00:{s:02d}.5") for s in range(1, 50) if s % 7]
    df = spark.createDataFrame(data, "k long, step long, x double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    snaps = {r.step: r.snapshot for r in series.snapshot_asof(df, "k", "step", "x", 10, block_rows=8).collect()}
    times = {r.step: r.step_seconds for r in series.step_time(df, "k", "step", "ts", block_rows=8).collect()}
    previous = None
    for _, s, _, _ in data:
        # Only steps that exist were snapshots; the latest one at or before s counts.
        taken = [t for _, t, _, _ in data if t % 10 == 0 and t <= s]
        assert snaps[s] == (float(taken[-1] ** 2) if taken else None)
        assert times[s] == (None if previous is None else float(s - previous))
        previous = s


def test_on_off_policy_window_without_one_side(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.0, True), (11, 4.0, False)], "step long, loss double, on_policy boolean")
    got = {r.log_window: (r.on_policy_loss, r.off_policy_loss) for r in series.on_off_policy_loss(df, 10, 8).collect()}
    assert got == {0: (12.0, None), 1: (None, 32.0)}
