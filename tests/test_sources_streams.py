import datetime as dt
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolltally.functions import arrays as R
from rolltally.functions.answers import answer_key
from rolltally.operators import assemble, sampling, vote
from rolltally.operators.ordering import numbered_all
from rolltally.plans import catalog
from rolltally.sources import flushes, problems, runs, sinks, views
from rolltally.sources.staging import new_path, stage
from rolltally.streaming import jobs


def test_field_mapping_goes_by_presence(spark):
    df = spark.createDataFrame([("q", None, "kept")], "question string, Answer int, answer2 string").withColumnRenamed("answer2", "other")
    assert problems.normalize_fields(df).collect() == [("q", None)]
    df = spark.createDataFrame([("p", 5, "s")], "problem string, answer int, solution string")
    assert problems.normalize_fields(df).first().asDict() == {"problem": "p", "answer": "5", "solution": "s"}
    with pytest.raises(ValueError, match="no problem field"):
        problems.normalize_fields(spark.range(1))


def test_benchmarks(spark):
    path = new_path(spark, "bench")
    spark.createDataFrame([("q1", 7, 3)], "question string, answer int, id int").write.parquet(f"{path}/minerva/test")
    assert problems.read_benchmark(spark, path, "Minerva").collect() == [("minerva", "3", "q1", "7")]
    with pytest.raises(ValueError, match="unknown benchmark"):
        problems.read_benchmark(spark, path, "other")


def test_json_lines_source(spark):
    path = new_path(spark, "jsonl")
    spark.createDataFrame([("p", "1")], "problem string, answer string").write.json(path)
    assert problems.read_problems(spark, path, "json", "problem string, answer string").collect() == [("p", "1")]
    with pytest.raises(ValueError):
        problems.read_problems(spark, path, "csv")


def test_latest_checkpoint_is_numeric(spark):
    rows = [("a", "a/checkpoint-9"), ("a", "a/checkpoint-100"), ("a", "a/checkpoint-x"), ("a", "a/final"), ("b", "b/other")]
    got = runs.latest_checkpoint(spark.createDataFrame(rows, "run string, path string")).collect()
    assert got == [("a", "a/checkpoint-100", 100)]


def test_flush_steps_keep_every_step(spark):
    df = spark.range(13).select(sinks.flush_step(F.col("id")).alias("f"))
    assert [r.f for r in df.collect()] == [5] * 6 + [10] * 5 + [15] * 2


def test_log_round_trip(spark, sf_dir):
    texts, flags = catalog._log_texts(spark, sf_dir), catalog._log_flags(spark, sf_dir)
    log = sinks.rollout_log(texts, flags)
    path = new_path(spark, "log")
    rows = flushes.flush_rows(texts, flags, sinks.flush_step(catalog.step_of()))
    flushes.write_flushes(rows, path)
    flushes.write_flushes(rows, path)  # a flush that is written again replaces itself
    docs = flushes.read_flushes(spark, path)
    back = docs.select(F.inline("generations"))
    columns = [c for c in log.columns]
    assert back.count() == log.count() and back.select(columns).exceptAll(log).isEmpty()
    assert docs.where("num_samples <> size(generations)").isEmpty() and docs.select("step").distinct().count() == docs.count()
    order = docs.where(~F.expr("generations = array_sort(generations, (a, b) -> CASE WHEN a.prompt_id < b.prompt_id OR (a.prompt_id = b.prompt_id AND a.rollout_idx < b.rollout_idx) THEN -1 ELSE 1 END)"))
    assert order.isEmpty()


def test_texts_of_the_log_cross_one_exchange(spark, sf_dir):
    rows = flushes.flush_rows(catalog._log_texts(spark, sf_dir), catalog._log_flags(spark, sf_dir), sinks.flush_step(catalog.step_of()))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    carrying = [line for line in plan.splitlines() if re.search(r"Exchange", line)]
    assert sum("REPARTITION_BY_COL" in line for line in carrying) == 1
    above = plan[: plan.index("REPARTITION_BY_COL")]
    assert "Join" not in above and "Window" not in above
    below = plan[plan.index("REPARTITION_BY_COL") :]
    texts = below[: below.index("Join")]  # the branch of the texts comes first
    assert "completion" in texts and texts.count("Exchange") == 0


def test_a_lost_task_publishes_nothing(spark):
    path = new_path(spark, "lost")
    row = {"flush_step": 5, "kind": 1, "step": 1, "prompt_id": 1, "rollout_idx": 0, "prompt": "p", "completion": "c \u00e9\n", "ground_truth": "", "answer": None, "is_selected": None, "is_majority": None, "direction_sign": None}
    batch = pa.RecordBatch.from_pylist([row, row | {"rollout_idx": 1}])
    writer = flushes.FlushWriter(path)

    def breaks():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    done, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert flushes.read_flushes(spark, path).isEmpty()
    writer.abort([done, None])
    writer.commit([again, None])
    docs = flushes.read_flushes(spark, path).collect()
    assert [(d.step, d.num_samples, [g.completion for g in d.generations]) for d in docs] == [(5, 2, ["c \u00e9\n"] * 2)]


def test_documents_are_json_whatever_the_values(spark):
    path = new_path(spark, "values")
    texts = ['say "hi"\\n', "\x00\x1f\u2028 \u00e9\U0001f600", "", None]
    marks = [{"flush_step": 5, "kind": 0, "step": None, "prompt_id": 1, "rollout_idx": i, "prompt": None, "completion": None, "ground_truth": None, "answer": t, "is_selected": i == 0, "is_majority": None, "direction_sign": -1} for i, t in enumerate(texts)]
    rows = [{"flush_step": 5, "kind": 1, "step": 1, "prompt_id": 1, "rollout_idx": i, "prompt": t, "completion": t, "ground_truth": t, "answer": None, "is_selected": None, "is_majority": None, "direction_sign": None} for i, t in enumerate(texts)]
    both = [r for pair in zip(marks, rows) for r in pair]
    writer = flushes.FlushWriter(path)
    writer.commit([writer.write(iter(pa.RecordBatch.from_pylist(both[lo : lo + 3]) for lo in range(0, 8, 3)))])
    (doc,) = flushes.read_flushes(spark, path).collect()
    assert [(g.prompt, g.answer, g.is_selected, g.is_majority, g.direction_sign) for g in doc.generations] == [(t, t, i == 0, None, -1) for i, t in enumerate(texts)]


def test_sampling_does_not_depend_on_partitioning(spark):
    one = spark.range(0, 5000, 1, 1).withColumnRenamed("id", "k")
    many = one.repartition(13)
    pick = lambda df: [r.k for r in sampling.sample_n(df, ["k"], 20).collect()]
    assert pick(one) == pick(many) and len(set(pick(one))) == 20
    split = lambda df: {r.k for r in sampling.train_eval_split(df, ["k"]).where("split = 'test'").collect()}
    assert split(one) == split(many) and 10 <= len(split(one)) <= 70
    assert sampling.sample_n(one.limit(3), ["k"], 20).count() == 3


def test_dedup_keeps_the_first_of_a_hot_key(spark):
    rows = [(0 if i % 3 else i, 0, 1000 - i) for i in range(1000)]
    df = spark.createDataFrame(rows, "p long, k long, o long").repartition(8)
    got = {r.p: r.o for r in sampling.dedup(df, ["p", "k"], ["o"]).collect()}
    want = {}
    for p, _, o in rows:
        want[p] = min(o, want.get(p, o))
    assert got == want


def test_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), ([0, 4],)], "ids array<int>")
    got = [r[0] for r in df.select(R.pad_truncate(F.col("ids"), 2, 0)).collect()]
    assert got == [[5, 6], [0, 0], [0, 4]]
    labels = df.select(R.label_mask(R.pad_truncate(F.col("ids"), 4, 0), F.lit(1), 0)).collect()
    assert [r[0] for r in labels] == [[-100, 6, 7, -100], [-100] * 4, [-100, 4, -100, -100]]
    assert R.prompt_limit(20, 12) == 8 and R.prompt_limit(5, 12) == 1 and R.prompt_limit(None, 12) is None


def test_training_set(spark):
    chosen = spark.createDataFrame(
        [(0, 1, 3, 0, 1, 0.5), (0, 1, 1, 1, -1, -0.5), (0, 2, 0, 0, 1, 1.0), (0, 2, 5, 1, 1, 1.0)],
        "step long, prompt_id long, rollout_idx long, sel_rank long, direction_sign int, advantage double",
    )
    prompts = spark.createDataFrame([(1, [1, 2, 3], [9]), (2, [4], [8, 8]), (3, [7] * 9, [7])], "prompt_id long, student_ids array<int>, teacher_ids array<int>")
    completions = spark.createDataFrame(
        [(1, 3, [11]), (1, 1, [12, 13, 14, 15]), (2, 0, []), (2, 5, [16, 17])], "prompt_id long, rollout_idx long, token_ids array<int>"
    )
    rows = assemble.training_set(chosen, prompts, completions, ["step"], 0, 3, 5).orderBy("position").collect()
    assert [(r.prompt_id, r.rollout_idx) for r in rows] == [(1, 3), (2, 0), (1, 1), (2, 5)]
    assert [r.student_input_ids for r in rows] == [[1, 2, 11, 0, 0], [4, 0, 0, 0, 0], [1, 2, 12, 13, 14], [4, 0, 16, 17, 0]]
    assert [r.teacher_input_ids for r in rows] == [[9, 0, 11, 0, 0], [8, 8, 0, 0, 0], [9, 0, 12, 13, 14], [8, 8, 16, 17, 0]]
    assert rows[3].student_attention_mask == [1, 0, 1, 1, 0]
    assert [r["labels"] for r in rows] == [[-100, -100, 11, -100, -100], [-100] * 5, [-100, -100, 12, 13, 14], [-100, -100, 16, 17, -100]]


def test_staged_tables_are_read_back(spark):
    df = stage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "LocalTableScan" not in df._jdf.queryExecution().executedPlan().toString()


def minute(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def write_batches(spark, name, batches, schema):
    path = new_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_vote_over_several_batches(spark):
    schema = "prompt_id long, rollout_idx long, answer string, ts timestamp"
    batches = [
        [(1, 0, "2", minute(1)), (1, 1, "3", minute(2)), (2, 0, None, minute(3))],
        [(1, 2, "6:2", minute(5)), (2, 1, "7", minute(8)), (1, 3, "3", minute(9))],
        [(9, 0, "1", minute(500))],
        [(9, 1, "1", minute(501))],
        [(1, 4, "2", minute(3)), (9, 2, "1", minute(502))],
    ]
    path = write_batches(spark, "vote-in", batches, schema)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = rows.withColumn("answer_key", answer_key(F.col("answer")))
    got = jobs.vote(jobs.drain_partials(rows, lambda b: jobs.vote_partials(b, ["rollout_idx"]), "vote-out"))
    want = {(1, "3", 3, 5), (2, "7", 1, 2), (9, "1", 3, 3)}
    assert {(r.prompt_id, r.pseudo_label, r.consensus_count, r.n_rollouts) for r in got.collect()} == want


@pytest.mark.parametrize("files", [1, 4, 16])
def test_streams_do_not_depend_on_files(spark, sf_dir, files):
    """Vote and metric windows over the whole table, in any number of micro-batches, equal the batch job."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*views.ITEM)
    path = new_path(spark, "files-in")
    items.repartition(files).write.parquet(path)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = lambda df: vote.with_answers(views.rollouts_of(df, views.ORDER))
    got = jobs.vote(jobs.drain_partials(rows(stream), lambda b: jobs.vote_partials(b, views.ORDER), "files-out"))
    want = jobs.vote(jobs.vote_partials(rows(items), views.ORDER))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == items.select("l_partkey").distinct().count()
    assert got.agg(F.sum("n_rollouts")).first()[0] == items.count()


def test_empty_stream(spark):
    path = new_path(spark, "empty-in")
    spark.createDataFrame([], "prompt_id long, rollout_idx long, answer string, answer_key string").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    assert jobs.vote(jobs.drain_partials(stream, lambda b: jobs.vote_partials(b, ["rollout_idx"]), "empty-out")).collect() == []


def test_stream_dedup_over_batches(spark):
    schema = "prompt_id long, rollout_idx long, ts timestamp"
    path = write_batches(spark, "dd-in", [[(1, 0, minute(0)), (1, 0, minute(1))], [(1, 0, minute(2)), (1, 1, minute(2))]], schema)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain(jobs.dedup(rows, ["prompt_id", "rollout_idx"], "1 hour"), "dd-out")
    assert sorted((r.prompt_id, r.rollout_idx) for r in got.collect()) == [(1, 0), (1, 1)]


def metric_rows(n=300):
    """(name, value, ts, arrived) in order of arrival: most come within the hour, some two hours later, some after a day."""
    rows = [(name, float(m % 7), minute(m), minute(m + {0: 1500, 1: 100}.get(m % 11, m % 13))) for m in range(0, n, 3) for name in ("a", "b")]
    return sorted(rows, key=lambda r: r[3])


@pytest.mark.parametrize("cuts", [1, 2, 5, 25])
def test_metric_windows_with_disorder_inside_and_outside_the_delay(spark, cuts):
    schema = "name string, value double, ts timestamp, arrived timestamp"
    rows = metric_rows()
    size = -(-len(rows) // cuts)
    path = write_batches(spark, "mw-in", [rows[i : i + size] for i in range(0, len(rows), size)], schema)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    closed, state = jobs.drained(jobs.metric_windows(read(), "1 hour", "2 hours"), "mw")
    still = jobs.open_windows(spark, state)
    late = jobs.drain(jobs.late_rows(read(), "2 hours"), "mw-late")
    on_time = [r for r in rows if r[3] - r[2] <= dt.timedelta(hours=2)]
    assert 0 < len(on_time) < len(rows)
    assert sorted(map(tuple, late.collect())) == sorted(r for r in rows if r not in on_time)
    want = {}
    for name, value, ts, _ in on_time:
        want.setdefault((ts.replace(minute=0), name), []).append(value)
    latest = max(r[2] for r in on_time)
    ends = lambda start: start + dt.timedelta(hours=3) <= latest
    means = lambda df: {(r.window.start, r.name): (r.mean_value, r.n_values) for r in jobs.window_means(df).collect()}
    mean = lambda v: (sum(v) / len(v), len(v))
    assert means(closed) == {k: mean(v) for k, v in want.items() if ends(k[0])} and means(closed)
    assert means(still) == {k: mean(v) for k, v in want.items() if not ends(k[0])} and means(still)


def states(query):
    return [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]


def run_memory(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in stream.sparkSession.table(name).collect()], states(query)


@pytest.mark.parametrize("files", [1, 4, 16])
def test_votes_are_emitted_once_and_forgotten(spark, sf_dir, files):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*views.ITEM)
    path = new_path(spark, "arrive-in")
    items.repartition(files, "l_orderkey").write.option("maxRecordsPerFile", 10_000).parquet(path)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = lambda df: vote.with_answers(views.rollouts_of(df, views.ORDER))
    asked = items.groupBy(F.col("l_partkey").alias("prompt_id")).agg(F.count("*").alias("expected"))
    got, kept = run_memory(jobs.vote_on_arrival(rows(stream).join(asked, "prompt_id"), views.ORDER), f"votes_{files}")
    want = jobs.vote(jobs.vote_partials(rows(items), views.ORDER)).collect()
    assert sorted((p, label, n, m) for p, label, n, m, _ in got) == sorted(map(tuple, want)) and all(r[-1] for r in got)
    assert kept[-1] == 0 and (files == 1 or max(kept) > 0)


@pytest.mark.parametrize("files", [1, 4])
def test_drained_votes_wait_for_all_rollouts(spark, sf_dir, files):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*views.ITEM)
    path = new_path(spark, "drain-in")
    items.repartition(files, "l_orderkey").write.parquet(path)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = lambda df: vote.with_answers(views.rollouts_of(df, views.ORDER))
    more = F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)  # these never get complete
    asked = items.groupBy(F.col("l_partkey").alias("prompt_id")).agg((F.count("*") + F.max(more)).alias("expected"))
    got = jobs.drain_votes(rows(stream), views.ORDER, asked, "drained").collect()
    want = jobs.vote(jobs.vote_partials(rows(items), views.ORDER)).where("prompt_id % 7 <> 0").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_registered_votes_need_no_python_state(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jobs, "_decide", None)
    assert catalog.QUERIES["stream_vote"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().count()


def test_drained_folders_have_one_file(spark):
    """Every source file has rows of every flush; a flush is written by one task all the same."""
    path = new_path(spark, "log-in")
    spark.range(4000).select("id", (F.col("id") % 20).alias("flush_step")).repartition(8).write.parquet(path)
    log = jobs.drain(jobs.read_stream(spark, path, "id long, flush_step long"), "log", ["flush_step"])
    assert log.count() == 4000 and len(log.inputFiles()) == 20


def test_eval_report_is_compressed(spark):
    """Texts that repeat take a small part of their length on disk, and come back whole."""
    rows = spark.range(2000).select(F.lit("d").alias("dataset"), F.lit("said").alias("full_generation"), F.repeat(F.lit("so "), 200).alias("text"))
    path = new_path(spark, "report")
    sinks.write_eval_report(rows.limit(1), rows.limit(1), rows, path)
    back = spark.read.schema(rows.schema).json(f"{path}/generations")
    assert back.count() == 2000 and back.select(rows.columns).distinct().collect() == rows.distinct().collect()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/generations")
    assert files.agg(F.sum("length")).first()[0] < 2000 * 600 / 10


def test_votes_when_the_time_is_up(spark):
    """Prompt 1 gets complete, 2 never does, 3 gets a straggler after its time; 9 moves the watermark."""
    schema = "prompt_id long, rollout_idx long, answer string, ts timestamp, expected long"
    batches = [
        [(1, 0, "2", minute(0), 3), (1, 1, "1+1", minute(1), 3), (2, 0, "x+1", minute(0), 4), (3, 0, None, minute(0), 2)],
        [(2, 1, "1+x", minute(5), 4), (1, 2, "4", minute(6), 3)],
        [(9, 0, "0", minute(60), 9)],
        [(1, 3, "4", minute(61), 3)],
        [(9, 1, "0", minute(300), 9)],
        [(9, 2, "0", minute(301), 9)],
    ]
    path = write_batches(spark, "up-in", batches, schema)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("answer_key", answer_key(F.col("answer")))
    got, kept = run_memory(jobs.vote_on_arrival(rows, ["rollout_idx"], "10 minutes"), "votes_up")
    assert sorted(r for r in got if r[0] < 9) == [(1, "2", 2, 3, True), (2, "x+1", 2, 2, False), (3, None, 0, 1, False)]
    assert kept[-1] <= 1  # only prompt 9 may be open


def test_rows_of_a_prompt_are_combined_before_the_exchange(spark):
    n = 30_000
    path = new_path(spark, "hot-in")
    spark.range(n).select(F.lit(1).alias("prompt_id"), F.col("id").alias("rollout_idx"), F.lit("2").alias("answer"), F.lit("n:2.000000").alias("answer_key"), F.lit(n).alias("expected")).coalesce(3).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = jobs.vote_on_arrival(stream, ["rollout_idx"]).writeStream.format("memory").queryName("hot").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("hot").collect()] == [(1, "2", n, n, True)]
    assert max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]) <= 1
    plan = query._jsq.explainInternal(False) if hasattr(query._jsq, "explainInternal") else ""
    assert not plan or plan.index("MapInArrow") > plan.index("FlatMapGroupsInPandasWithState")


def test_views_do_not_depend_on_hot_groups(spark, sf_dir):
    plain, hot = views.build_rollouts(spark, sf_dir), views.build_rollouts(spark, sf_dir, hot_rows=5)
    columns = ["prompt_id", "rollout_idx", "completion"]
    assert plain.select(columns).exceptAll(hot.select(columns)).isEmpty() and plain.count() == hot.count()
    steps, split = views.build_steps(spark, sf_dir), views.build_steps(spark, sf_dir, hot_rows=2)
    assert steps.exceptAll(split.select(steps.columns)).isEmpty()
    tokens, cut = views.build_tokens(spark, sf_dir), views.build_tokens(spark, sf_dir, hot_rows=2)
    columns = ["seq_id", "sample_id", "pos", "token_id"]
    assert tokens.select(columns).exceptAll(cut.select(columns)).isEmpty()


def test_sample_expand(spark):
    got = vote.sample_expand(spark.range(3).withColumnRenamed("id", "prompt_id"), 2)
    assert sorted(map(tuple, got.collect())) == [(p, k) for p in range(3) for k in range(2)]


def test_benchmarks_without_ids_are_numbered(spark):
    """Two problems of a set without ids stay two problems in the report."""
    rows = spark.createDataFrame([("b", "so \\boxed{2}"), ("a", "so \\boxed{1}"), ("a", "so \\boxed{3}")], "problem string, solution string")
    got = problems.map_benchmark(rows, "math500").collect()
    assert sorted(r.problem_id for r in got) == ["0", "1", "2"] and {r.ground_truth for r in got if r.problem == "b"} == {"2"}


def test_benchmark_without_ids_keeps_null_problems(spark):
    """No row is lost, texts that begin alike or are equal go into many ranges, numbers follow the texts with nulls last."""
    texts = [f"What is {i:04d}?" for i in range(900)] + ["What is it?"] * 600 + [None, None]
    rows = spark.createDataFrame([(t, "so \\boxed{1}") for t in texts], "problem string, solution string").repartition(5)
    got = sorted(problems.map_benchmark(rows, "math500").collect(), key=lambda r: int(r.problem_id))
    assert [int(r.problem_id) for r in got] == list(range(len(texts)))
    assert [r.problem for r in got] == texts


def test_fields_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, "q", "5", "6")], "id long, question string, Answer string, other string").toDF("id", "question", "Answer", "answer")
    assert problems.normalize_fields(df, keep=["id"]).collect() == [(1, "q", "5")]


@pytest.mark.parametrize(
    ("path", "want"),
    [("out/run/checkpoint-25", "run_checkpoint-25"), ("a/checkpoint-25/", "a_checkpoint-25"), ("checkpoint-25", "_checkpoint-25"), (None, None)],
)
def test_run_key_of_odd_paths(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    key = runs.run_key(F.lit("d"), F.lit("org/m/"), F.col("p"), F.lit(True), F.lit(0.6), F.lit(4))
    middle = "" if want is None else f"_{want}"
    assert df.select(key).first()[0] == f"eval_results_d_m{middle}_thinking_temp0.6_valn4"


def test_shards_go_by_row_position(spark):
    df = spark.createDataFrame([(i,) for i in (10, 20, 30, 40)], "id long")
    rows = numbered_all(df, ["id"], "row")
    assert {r.id: r.shard for r in sampling.shard_interleaved(rows, "row", 2).collect()} == {10: 0, 20: 1, 30: 0, 40: 1}


def test_tokens_keep_every_vector(spark, sf_dir):
    tokens = views.build_tokens(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert tokens.count() == vectors.count() and tokens.where("teacher is null").isEmpty()
    per = tokens.groupBy("seq_id", "sample_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("k"))
    assert per.where("last <> n - 1 or k <> n").isEmpty()
