"""Registered queries: every operator over whole tables, one name each.

Floating-point results are rounded to six decimals, arrays are returned as comma-separated text, so that both
sides of a comparison have plain columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.config import BatchParams, LossParams, SelectParams, VoteParams
from rolltally.functions import answers as A
from rolltally.functions import arrays as R
from rolltally.functions import prompts as P
from rolltally.functions import vectors as V
from rolltally.operators import assemble, evaluation, quality, reports, rewards, sampling, select, series, vote
from rolltally.operators import tokens as T
from rolltally.operators.ordering import numbered_all
from rolltally.plans.session import configure, narrow_scans
from rolltally.sources import problems as problem_sets
from rolltally.sources import flushes, runs, sinks, views
from rolltally.sources.staging import new_path, stage, staged, staged_path
from rolltally.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOTE = VoteParams(min_consensus=6)
SELECT = SelectParams(k_train=8, positive_fraction=0.5)
LOSS = LossParams()
BENCHES = [f"bench{i}" for i in range(5)]
MAX_TOKENS, MAX_LENGTH, PAD = 12, 20, 0


def query(build: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(narrow_scans(configure(spark)), sf_dir))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def csv(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "votes", lambda: vote.majority_vote(views.answers(spark, sf_dir)))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "clusters", lambda: quality.clusters(views.answers(spark, sf_dir)))


def selected(spark: SparkSession, sf_dir: str, params: SelectParams = SELECT) -> DataFrame:
    return select.select_rollouts(views.answers(spark, sf_dir), votes(spark, sf_dir), VOTE, params)


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default selection as a table, for what builds on it."""
    return staged(spark, sf_dir, "chosen", lambda: selected(spark, sf_dir))


#: Prompts per optimiser step and rollouts per micro-batch.
BATCH = BatchParams(batch=4, accumulation=8, k_train=8)


def step_of(prompt: str = "prompt_id") -> Column:
    return F.floor(F.col(prompt) / 8).cast("bigint")


# --- sources, sinks, partitioning


@query
def scan_problems(spark, d):
    df = problem_sets.read_problems(spark, f"{d}/part.parquet")
    return df.select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("problem"), F.col("p_size").alias("answer"))


@query
def benchmark_registry(spark, d):
    """The benchmark table in the field layout of each of the ten sets, mapped to one schema."""
    items = views.table(spark, d, "benchmark")
    tables = {}
    for name, (_, problem, answer, ident) in problem_sets.BENCHMARKS.items():
        columns = [F.col("text").alias(problem)]
        if answer:
            columns.append((F.col("item_id") * 3).alias(answer))
        else:
            boxed = F.concat(F.lit("so \\boxed{"), F.col("item_id").cast("string"), F.lit("}."))
            columns.append(F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise(boxed).alias("solution"))
        if ident:
            columns.append(F.col("item_id").alias(ident))
        tables[name] = items.select(*columns)
    return problem_sets.union_benchmarks(tables)


@query
def normalize_fields(spark, d):
    raw = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("question"),
        F.when(F.col("p_size") % 3 == 0, None).otherwise(F.col("p_size")).alias("Answer"),
        F.col("p_type").alias("solution"),
        "p_brand",
    )
    return problem_sets.normalize_fields(raw, keep=["id"])


@query
def head_n(spark, d):
    return sampling.head_n(views.problems(spark, d), ["prompt_id"], 100)


@query
def train_eval_split(spark, d):
    return sampling.train_eval_split(views.problems(spark, d).select("prompt_id"), ["prompt_id"])


@query
def shard_interleaved(spark, d):
    rows = views.problems(spark, d).select("prompt_id")
    rows = numbered_all(rows, ["prompt_id"], "_row")
    return sampling.shard_interleaved(rows, "_row", 8).drop("_row")


def _log_flags(spark, d):
    rows = vote.join_votes(views.answers(spark, d).drop("ground_truth"), votes(spark, d))
    return sinks.log_flags(rows, chosen(spark, d))


def _log_texts(spark, d):
    """Rollouts with the prompt as the model was given it."""
    return sinks.log_texts(views.rollouts(spark, d), P.student_prompt(F.col("problem")), step_of())


@query
def rollout_log(spark, d):
    """The log's rows; texts as digests, so that they can be compared."""
    log = sinks.rollout_log(_log_texts(spark, d), _log_flags(spark, d))
    texts = ["prompt", "completion"]
    return log.select(*[c for c in log.columns if c not in texts], *[F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in texts])


@query
def write_rollout_log(spark, d):
    """Written as one document per flush and read back."""
    path = new_path(spark, "rollout-log")
    flush = sinks.flush_step(step_of())
    flushes.write_flushes(flushes.flush_rows(_log_texts(spark, d), _log_flags(spark, d), flush), path)
    made = F.col("generations")
    return flushes.read_flushes(spark, path).select(
        F.col("step").alias("flush_step"), "num_samples", F.size(made).cast("bigint").alias("n_generations"),
        F.size(F.filter(made, lambda g: g["is_selected"])).cast("bigint").alias("n_selected"), F.size(F.filter(made, lambda g: g["is_majority"])).cast("bigint").alias("n_majority"),
        F.sha2(F.array_join(F.transform(made, lambda g: F.concat(g["prompt"], g["completion"], g["answer"])), "|"), 256).alias("texts_sha256"),
    )


@query
def write_eval_report(spark, d):
    """The report is written as JSON, read back, and its generations are counted."""
    per = stage(evaluation.per_problem(views.graded(spark, d)), "per-problem")
    rows = evaluation.graded_texts(views.eval_rollouts(spark, d))
    results, flat = evaluation.report(per, rows), evaluation.generations(rows)
    path = new_path(spark, "eval-report")
    sinks.write_eval_report(evaluation.summary(per), results, flat, path)
    back = spark.read.schema(results.schema).json(f"{path}/results")
    counts = spark.read.schema(flat.schema).json(f"{path}/generations").groupBy(*evaluation.PROBLEM)
    counts = counts.agg(F.count(F.lit(1)).alias("n_generations"), F.count_if("correct").alias("n_correct"))
    return back.join(counts, evaluation.PROBLEM).select(
        "dataset", "problem_id", "problem", "ground_truth", "val_n", "num_correct", "majority_vote_correct", "n_generations", "n_correct",
        F.col("full_generation").alias("first_generation"),
    )


@query
def latest_checkpoint(spark, d):
    orders = views.table(spark, d, "orders")
    run = F.concat(F.lit("run"), F.col("o_custkey").cast("string"))
    name = F.when(F.col("o_orderkey") % 5 == 0, "final").otherwise(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")))
    return runs.latest_checkpoint(orders.select(run.alias("run"), F.concat(run, F.lit("/"), name).alias("path")))


@query
def run_key(spark, d):
    key = F.col("o_orderkey")
    ckpt = F.concat(F.lit("out/run"), (key % 3).cast("string"), F.lit("/checkpoint-"), key.cast("string"))
    named = runs.run_key(
        F.lower("o_orderstatus"),
        F.concat(F.lit("org/base-"), (F.col("o_custkey") % 4).cast("string")),
        F.when(key % 4 != 0, ckpt),
        key % 2 == 0,
        (key % 11) / 10,
        key % 16,
    )
    return views.table(spark, d, "orders").select("o_orderkey", named.alias("run_key"))


@query
def merge_batches(spark, d):
    problems = views.problems(spark, d).select("prompt_id", "problem")
    batches = [problems.where(F.col("prompt_id") % 3 == r) for r in (2, 0, 1)]
    return sampling.merge_batches(batches, ["prompt_id"], 1500)


# --- projections and string functions


@query
def student_prompt(spark, d):
    problem = F.col("problem")
    return views.problems(spark, d).select(
        "prompt_id",
        *[P.student_prompt(problem, style).alias(f"{style}_prompt") for style in ("train", "compact", "eval")],
    )


@query
def teacher_prompt(spark, d):
    problem, truth = F.col("problem"), F.col("ground_truth")
    return views.problems(spark, d).select(
        "prompt_id",
        P.teacher_prompt(problem, truth).alias("teacher_prompt"),
        P.teacher_prompt(problem, truth, "none").alias("plain_prompt"),
    )


@query
def reason_first_prompt(spark, d):
    asked = P.reason_first_prompt(F.col("p_name"), F.col("p_type"))
    return views.table(spark, d, "part").select(
        F.col("p_partkey").alias("prompt_id"),
        asked.alias("reasoning_prompt"),
        P.reason_first_followup(asked, F.col("p_brand")).alias("teaching_prompt"),
    )


@query
def extract_boxed_first(spark, d):
    return vote.with_answers(views.rollouts(spark, d)).select("prompt_id", "rollout_idx", "answer")


@query
def extract_boxed_last(spark, d):
    return vote.with_answers(views.rollouts(spark, d), rule="last").select("prompt_id", "rollout_idx", "answer")


@query
def ratio_to_fraction(spark, d):
    return views.answers(spark, d).select("prompt_id", "rollout_idx", A.ratio_to_fraction(F.col("answer")).alias("answer"))


@query
def normalize_answer(spark, d):
    return views.answers(spark, d).select("prompt_id", "rollout_idx", A.normalize_answer(F.col("answer")).alias("answer"))


@query
def normalize_answer_eval(spark, d):
    dollars = F.concat(F.lit(" $"), "answer", F.lit("$ "))
    return views.answers(spark, d).select("prompt_id", "rollout_idx", A.normalize_answer_eval(dollars).alias("answer"))


@query
def answer_key(spark, d):
    return views.answers(spark, d).select("prompt_id", "rollout_idx", A.answer_key(F.col("answer")).alias("answer_key"))


@query
def ground_truth_or_solution(spark, d):
    return views.rollouts(spark, d).select(
        "prompt_id", "rollout_idx", A.ground_truth_or_solution(F.col("completion")).alias("truth")
    )


@query
def strip_pad_token(spark, d):
    padded = F.concat(F.lit("<pad><pad>"), "problem", F.lit("<pad>"))
    return views.problems(spark, d).select("prompt_id", P.strip_pad_token(padded, "<pad>").alias("prompt"))


@query
def repair_queue(spark, d):
    rows = vote.with_answers(views.rollouts(spark, d).withColumn("text", F.col("completion")), "text")
    prefix = F.concat(P.student_prompt(F.col("problem")), "completion", P.forced_prefix(F.col("completion")))
    return rows.where(~A.has_answer(F.col("answer"))).select("prompt_id", "rollout_idx", prefix.alias("prefix"))


@query
def merge_repairs(spark, d):
    return views.answers(spark, d).select("prompt_id", "rollout_idx", "answer", "answer_key", "recovered")


@query
def repair_rates(spark, d):
    return vote.repair_rates(views.answers(spark, d))


# --- joins


@query
def join_vote_back(spark, d):
    return vote.join_votes(views.answers(spark, d), votes(spark, d)).select(
        "prompt_id", "rollout_idx", "answer", "pseudo_label", "consensus_count", "is_majority"
    )


@query
def join_ground_truth(spark, d):
    answers = views.answers(spark, d).select("prompt_id", "rollout_idx", "answer")
    return vote.join_ground_truth(answers, views.problems(spark, d))


@query
def answer_equijoin(spark, d):
    answers = views.answers(spark, d).select("prompt_id", "rollout_idx", "answer_key")
    problems = views.problems(spark, d)
    both = vote.matching(answers, problems).withColumn("matched", F.lit(True)).unionByName(
        vote.not_matching(answers, problems).withColumn("matched", F.lit(False))
    )
    return both.select("prompt_id", "rollout_idx", "matched")


@query
def selected_lookup(spark, d):
    answers = views.answers(spark, d).select("prompt_id", "rollout_idx")
    return select.selected_lookup(answers, chosen(spark, d))


@query
def sample_expand(spark, d):
    return vote.sample_expand(views.problems(spark, d).select("prompt_id"), SELECT.k_train)


# --- voting, rewards, metrics


@query
def majority_vote(spark, d):
    return vote.majority_vote(views.answers(spark, d)).drop("label_key")


@query
def majority_vote_raw(spark, d):
    return vote.majority_vote_raw(views.graded(spark, d), ["dataset", "problem_id"])


@query
def gt_route(spark, d):
    known = views.answers(spark, d).where(A.has_answer(F.col("ground_truth")))
    return vote.route_ground_truth(known).drop("label_key")


@query
def consensus_gate(spark, d):
    return vote.consensus_gate(votes(spark, d), VOTE.threshold).select("prompt_id", "consensus_count")


@query
def consensus_counts(spark, d):
    return vote.consensus_counts(votes(spark, d), VOTE.threshold)


@query
def reward_majority(spark, d):
    rows = rewards.majority_reward(views.answers(spark, d), votes(spark, d), VOTE.threshold)
    return rows.select("prompt_id", "rollout_idx", "reward")


@query
def reward_ground_truth(spark, d):
    return views.answers(spark, d).select("prompt_id", "rollout_idx", rewards.ground_truth_reward().alias("reward"))


@query
def eval_per_problem(spark, d):
    return evaluation.per_problem(views.graded(spark, d))


@query
def eval_generations_nested(spark, d):
    return evaluation.generations(evaluation.graded_texts(views.eval_rollouts(spark, d)))


@query
def eval_summary(spark, d):
    return evaluation.summary(evaluation.per_problem(views.graded(spark, d)))


@query
def val_avg_pass(spark, d):
    rows = views.answers(spark, d).withColumn("correct", rewards.ground_truth_reward() > 0)
    return evaluation.validation(rows, val_n=32)


@query
def vote_metrics(spark, d):
    return quality.vote_metrics(clusters(spark, d), votes(spark, d), views.problems(spark, d), VOTE.threshold)


@query
def grpo_advantage(spark, d):
    rows = rewards.advantages(selected(spark, d), VOTE.threshold)
    return rows.select("prompt_id", "rollout_idx", "direction_sign", "advantage")


@query
def ema_series(spark, d):
    """Decay 200/201 instead of the default: with 0.995 early averages end in a 5 right behind the sixth decimal."""
    df = views.steps(spark, d).select("user_id", "step", "value")
    return series.ema(df, "user_id", "step", "value", 200 / 201)


@query
def snapshot_asof(spark, d):
    df = views.steps(spark, d).select("user_id", "step", "value")
    return series.snapshot_asof(df, "user_id", "step", "value", 10).select("user_id", "step", "snapshot")


@query
def rollout_accuracy(spark, d):
    return quality.rollout_accuracy(clusters(spark, d), votes(spark, d), views.problems(spark, d))


@query
def wrong_label_neither(spark, d):
    return quality.wrong_label_neither(clusters(spark, d), votes(spark, d), views.problems(spark, d))


@query
def signal_accuracy(spark, d):
    return quality.signal_accuracy(
        views.answers(spark, d), clusters(spark, d), votes(spark, d), chosen(spark, d), views.problems(spark, d), VOTE.threshold
    )


@query
def selection_metrics(spark, d):
    return quality.selection_metrics(clusters(spark, d), votes(spark, d), chosen(spark, d), VOTE.threshold, SELECT.k_train)


@query
def ratio_of_sums(spark, d):
    return quality.combine_shards(quality.shard_sums(views.answers(spark, d), F.col("rollout_idx") % 4))


@query
def metric_window_mean(spark, d):
    return series.metric_window_mean(views.steps(spark, d), 10)


@query
def on_off_policy_loss(spark, d):
    log = views.steps(spark, d).select("step", F.col("value").alias("loss"), (F.col("user_id") % 3 != 0).alias("on_policy"))
    return series.on_off_policy_loss(log, 10, 8)


@query
def generation_throughput(spark, d):
    log = views.answers(spark, d).select(step_of().alias("call"), "n_tokens", F.col("kl_score").alias("elapsed"))
    return quality.generation_throughput(log)


@query
def greedy_extraction_rate(spark, d):
    """Greedy answers are the first rollout of each prompt, after repair."""
    rows = views.rollouts(spark, d).where(F.col("rollout_idx") == 0)
    return quality.greedy_extraction_rate(vote.with_repairs(vote.with_answers(rows)))


# --- ranking and selection


def _selection(spark, d, strategy, fraction=0.5):
    params = SelectParams(SELECT.k_train, fraction, strategy, strategy)
    return selected(spark, d, params).select("prompt_id", "rollout_idx", "sel_rank", "direction_sign")


@query
def select_shortest(spark, d):
    return _selection(spark, d, select.SHORTEST)


@query
def select_max_kl(spark, d):
    return _selection(spark, d, select.MAX_KL)


@query
def select_computed_kl(spark, d):
    """Selection by the divergence of each rollout's own token positions: sample (prompt mod 10, rollout mod 4) of the token table holds them."""
    kl = T.trajectory_kl(views.scores(spark, d), 30).select("seq_id", "sample_id", F.round("kl_score", 6).alias("kl_score"))
    rows = views.answers(spark, d).drop("kl_score").withColumns({"seq_id": F.col("prompt_id") % 10, "sample_id": F.col("rollout_idx") % 4})
    scored = rows.join(kl, ["seq_id", "sample_id"], "left").fillna({"kl_score": float("-inf")})
    params = SelectParams(SELECT.k_train, 0.5, select.MAX_KL, select.MAX_KL)
    return select.select_rollouts(scored, votes(spark, d), VOTE, params).select("prompt_id", "rollout_idx", "sel_rank", "direction_sign")


@query
def select_max_logp(spark, d):
    return _selection(spark, d, select.MAX_LOGP)


@query
def select_longest(spark, d):
    return _selection(spark, d, select.LONGEST)


def _quotas(spark, d, fraction, *columns):
    params = SelectParams(SELECT.k_train, fraction)
    return select.class_quotas(votes(spark, d), VOTE, params).select("prompt_id", "n_pos", "n_neg", *columns)


@query
def quota_fixed(spark, d):
    return _quotas(spark, d, 0.3, "target_pos", "target_neg")


@query
def quota_sqrt(spark, d):
    return _quotas(spark, d, -1, "target_pos", "target_neg")


@query
def backfill(spark, d):
    return _quotas(spark, d, 0.9, "take_pos", "take_neg")


@query
def select_sqrt(spark, d):
    return _selection(spark, d, select.SHORTEST, -1)


@query
def select_naive(spark, d):
    return _selection(spark, d, select.SHORTEST, -2)


@query
def no_consensus_fallback(spark, d):
    rows = selected(spark, d).where(~F.col("agreed"))
    return rows.select("prompt_id", "rollout_idx", "sel_rank", "direction_sign")


@query
def direction_sign(spark, d):
    rows = select.inferred_signs(views.answers(spark, d), votes(spark, d), VOTE)
    return rows.select("prompt_id", "rollout_idx", "direction_sign")


@query
def teacher_privilege(spark, d):
    picks, rows = chosen(spark, d), views.rollouts(spark, d)
    trajectory = select.teacher_privilege(picks, rows, "trajectory").withColumnRenamed("privilege", "trajectory")
    label = select.teacher_privilege(picks, rows, "answer").withColumnRenamed("privilege", "label")
    return trajectory.join(label, "prompt_id")


@query
def rollout_major_order(spark, d):
    rows = chosen(spark, d).withColumn("step", step_of())
    return assemble.rollout_major_order(rows, ["step"]).select("step", "prompt_id", "rollout_idx", "position")


@query
def micro_batch_assign(spark, d):
    rows = assemble.micro_batches(chosen(spark, d), BATCH)
    return rows.select("prompt_id", "sel_rank", "step", "micro_batch")


def _ordered_problems(spark, d):
    return evaluation.per_problem(views.graded(spark, d)).withColumn("seq", F.floor(F.col("problem_id") / 5))


@query
def running_metrics(spark, d):
    return evaluation.running_metrics(_ordered_problems(spark, d))


@query
def progress_every_10(spark, d):
    return evaluation.progress(_ordered_problems(spark, d))


@query
def step_time(spark, d):
    return series.step_time(views.steps(spark, d), "user_id", "step", "ts").select("user_id", "step", "step_seconds")


@query
def last_n_log(spark, d):
    log = views.answers(spark, d).select(step_of().alias("step"), "prompt_id", "rollout_idx", "answer")
    newest = [F.col("step").desc(), F.col("prompt_id").desc(), F.col("rollout_idx").desc()]
    return series.last_rows(log, newest, 500)


@query
def topk_tokens(spark, d):
    return T.ranked_tokens(views.weighted(spark, d), 0.3).select("seq_id", "sample_id", "pos", "rank")


# --- set operations and sampling


@query
def dedup_rollouts(spark, d):
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("prompt_id"), F.col("l_linenumber").alias("rollout_idx"), "l_orderkey", "l_suppkey", "l_extendedprice"
    )
    return sampling.dedup(rows, ["prompt_id", "rollout_idx"], ["l_orderkey", "l_suppkey", "l_extendedprice"])


@query
def sample_n(spark, d):
    rows = views.answers(spark, d).select("prompt_id", "rollout_idx", "answer")
    return sampling.sample_n(rows, ["prompt_id", "rollout_idx"], 64)


@query
def group_duplicate_prompts(spark, d):
    rows = views.answers(spark, d).join(views.problems(spark, d).select("prompt_id", "problem"), "prompt_id")
    return vote.vote_by_text(rows, "problem", ["prompt_id", "rollout_idx"]).drop("label_key")


# --- token statistics

AT = ["seq_id", "sample_id", "pos"]


def _log_probs(spark, d, top_k=None):
    return T.with_log_probs(views.tokens(spark, d), LOSS.temperature, top_k)


@query
def log_softmax(spark, d):
    rows = views.tokens(spark, d).select(*AT, V.log_softmax(F.col("student"), LOSS.temperature).alias("ls"))
    return rows.select(*AT, F.posexplode("ls").alias("entry", "log_prob"))


@query
def token_entropy(spark, d):
    return T.entropy_report(views.scores(spark, d))


@query
def token_entropy_plain(spark, d):
    return T.entropy_report(views.scores(spark, d), "student_entropy")


@query
def sampled_logp(spark, d):
    return _log_probs(spark, d).select(*AT, V.sampled_logp(F.col("ls"), F.col("label")).alias("logp"))


@query
def forward_kl(spark, d):
    return _log_probs(spark, d).select(*AT, V.total(V.forward_kl_terms(F.col("ls"), F.col("lt"))).alias("kl"))


@query
def reverse_kl(spark, d):
    return _log_probs(spark, d).select(*AT, V.total(V.reverse_kl_terms(F.col("ls"), F.col("lt"))).alias("kl"))


@query
def generalized_jsd(spark, d):
    return _log_probs(spark, d).select(
        *AT, *[V.total(V.jsd_terms(F.col("ls"), F.col("lt"), beta)).alias(name) for name, beta in (("jsd_03", 0.3), ("jsd_05", 0.5))]
    )


@query
def divergence_clip(spark, d):
    terms = V.forward_kl_terms(F.col("ls"), F.col("lt"))
    return _log_probs(spark, d).select(
        *AT, V.clipped_sum(terms, 0.05, "element").alias("per_element"), V.clipped_sum(terms, 2.0, "token").alias("per_token")
    )


@query
def topk_renorm_jsd(spark, d):
    return _log_probs(spark, d, top_k=8).select(*AT, V.total(V.jsd_terms(F.col("ls"), F.col("lt"), 0.5)).alias("jsd"))


@query
def masked_reduction(spark, d):
    return T.masked_reduction(views.tokens(spark, d), 0.5, LOSS)


def _losses(spark, d, name, cases):
    """Mean loss for several parameters, one row each."""
    rows = [T.divergence_loss(views.weighted(spark, d), params).select(F.lit(value).alias(name), "loss", "n_samples") for value, params in cases]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query
def direction_kl(spark, d):
    return _losses(spark, d, "retention", [(r, LossParams(kl_mode=-1, retention=r)) for r in (0.0, 0.3, 1.0)])


@query
def direction_kl_swapped(spark, d):
    return _losses(spark, d, "retention", [(r, LossParams(kl_mode=-2, retention=r)) for r in (0.0, 0.3, 1.0)])


@query
def weighted_jsd(spark, d):
    rows = [
        T.divergence_loss(views.weighted(spark, d, LossParams(kl_mode=beta)), LossParams(kl_mode=beta)).select(F.lit(beta).alias("beta"), "loss", "n_samples")
        for beta in (0.0, 0.5, 1.0)
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query
def trajectory_kl(spark, d):
    return T.trajectory_kl(views.scores(spark, d), 30)


@query
def trajectory_logp(spark, d):
    mean = T.trajectory_logp(F.col("logprobs"))
    return views.rollouts(spark, d).select("prompt_id", "rollout_idx", mean.alias("logp_score"))


@query
def quantile_minmax(spark, d):
    rows = T.quantile_minmax(views.scores(spark, d), {"scaled": "student_entropy"})
    return rows.select(*AT, "scaled")


@query
def soft_or_weight(spark, d):
    return T.soft_or_weights(views.scores(spark, d)).select(*AT, "weight")


@query
def weighted_kl(spark, d):
    rows = views.weighted(spark, d)
    soft, top = T.weighted_kl(rows, 0.0), T.weighted_kl(rows, 0.3).withColumnRenamed("kl_loss", "top_share_loss")
    plain = T.weighted_kl(rows, 1.0).withColumnRenamed("kl_loss", "mean_loss")
    return soft.join(top, T.SAMPLE).join(plain, T.SAMPLE)


@query
def weight_monitor(spark, d):
    return T.weight_monitor(views.weighted(spark, d), 0.3)


@query
def policy_gradient_term(spark, d):
    return T.policy_gradient(views.scores(spark, d))


@query
def token_mask(spark, d):
    return T.token_mask(views.weighted(spark, d)).select(*AT, "mask_score", "masked_in")


@query
def hybrid_loss(spark, d):
    rows = T.hybrid_samples(views.weighted(spark, d), views.masked(spark, d), LOSS)
    return T.hybrid_loss(rows)


@query
def hybrid_loss_samples(spark, d):
    params = LossParams(kl_mode=-4)
    return T.hybrid_samples(views.weighted(spark, d), views.masked(spark, d), params)


@query
def branch_monitor(spark, d):
    masked = views.masked(spark, d)
    return T.branch_monitor(T.hybrid_samples(views.weighted(spark, d), masked, LOSS), masked, LOSS)


@query
def sampled_advantage(spark, d):
    return T.sampled_advantage(views.scores(spark, d))


# --- training-set assembly


def _ids(spark, d):
    return views.table(spark, d, "conversations").select("conv_id", "turn", views.ids_of(F.col("text")).alias("ids"))


@query
def pad_truncate(spark, d):
    return _ids(spark, d).select("conv_id", "turn", csv(R.pad_truncate(F.col("ids"), 32, PAD)).alias("ids"))


@query
def batch_max_length(spark, d):
    rows = assemble.pad_to_batch(_ids(spark, d), ["conv_id"], "ids", PAD, 64)
    return rows.select("conv_id", "turn", csv(F.col("padded")).alias("ids"), "padded_length")


@query
def attention_mask(spark, d):
    padded = R.pad_truncate(F.col("ids"), 32, PAD)
    return _ids(spark, d).select("conv_id", "turn", csv(R.attention_mask(padded, PAD)).alias("mask"))


@query
def label_mask(spark, d):
    padded = R.pad_truncate(F.col("ids"), 32, PAD)
    prompt_length = (F.col("conv_id") % 9).cast("int")
    return _ids(spark, d).select("conv_id", "turn", csv(R.label_mask(padded, prompt_length, PAD)).alias("labels"))


@query
def prompt_budget(spark, d):
    cut = R.prompt_budget(F.col("ids"), MAX_LENGTH, MAX_TOKENS)
    return _ids(spark, d).select("conv_id", "turn", csv(cut).alias("ids"))


@query
def build_training_set(spark, d):
    rows = assemble.micro_batches(rewards.advantages(chosen(spark, d), VOTE.threshold), BATCH).drop("prompt_rank", "micro_batch")
    labels = votes(spark, d).select("prompt_id", "pseudo_label")
    prompts = views.problems(spark, d).join(labels, "prompt_id").select(
        "prompt_id",
        views.ids_of(F.col("problem")).alias("student_ids"),
        views.ids_of(F.concat("problem", F.lit(" answer "), F.coalesce("pseudo_label", F.lit("")))).alias("teacher_ids"),
    )
    completions = views.rollouts(spark, d).select("prompt_id", "rollout_idx", views.ids_of(F.col("completion")).alias("token_ids"))
    table = assemble.training_set(rows, prompts, completions, ["step"], PAD, MAX_TOKENS, MAX_LENGTH)
    table = table.withColumn("micro_batch", F.floor(F.col("position") / BATCH.batch).cast("bigint"))
    arrays = ["student_input_ids", "student_attention_mask", "teacher_input_ids", "teacher_attention_mask", "labels"]
    plain = [c for c in table.columns if c not in arrays]
    return table.select(*plain, *[csv(F.col(c)).alias(c) for c in arrays])


# --- streaming


#: How long after its event time a step's metric still counts.
DELAY = "2 days"


def metric_log(events: DataFrame) -> DataFrame:
    """Events as a metric log with arrival times: most come hours later, every fiftieth after three days."""
    hours = F.when(F.col("event_id") % 50 == 0, 72).otherwise(F.col("event_id") % 7)
    ts = F.col("ts").cast("timestamp")
    return events.select(ts.alias("ts"), (ts + F.make_dt_interval(hours=hours.cast("int"))).alias("arrived"), F.col("event_type").alias("name"), views.cents())


@query
def stream_metric_window(spark, d):
    """Windows closed by the watermark, and those still open at the end."""
    log = metric_log(jobs.read_stream(spark, d, views.table(spark, d, "events").schema, "events.parquet"))
    closed, state = jobs.drained(jobs.metric_windows(log, "1 day", DELAY), "metric-windows")
    parts = [(closed, True), (jobs.open_windows(spark, state), False)]
    both = [jobs.window_means(w).withColumn("closed", F.lit(done)) for w, done in parts]
    return both[0].unionByName(both[1]).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "name", "mean_value", "n_values", "closed")


@query
def stream_late_metrics(spark, d):
    """What came too late for its window."""
    log = metric_log(jobs.read_stream(spark, d, views.table(spark, d, "events").schema, "events.parquet"))
    late = jobs.drain(jobs.late_rows(log, DELAY), "late-metrics")
    return late.groupBy("name").agg(F.count(F.lit(1)).alias("n_late"), F.sum("value").alias("sum_value"))


def expected_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """How many rollouts were asked for, per prompt."""
    return views.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("prompt_id")).agg(F.count(F.lit(1)).alias("expected"))


@query
def stream_vote(spark, d):
    """Votes as prompts get complete."""
    items = jobs.read_stream(spark, d, views.table(spark, d, "lineitem").schema, "lineitem.parquet")
    # A file with one row group would be read, and its texts searched, in one task.
    spread = items.select(*views.ITEM).repartition(*views.ORDER)
    rows = vote.with_repairs(vote.with_answers(views.rollouts_of(spread, views.ORDER)))
    return jobs.drain_votes(rows, views.ORDER, expected_rollouts(spark, d), "stream-vote")


@query
def stream_dedup(spark, d):
    """Line items by ship date as time of arrival; the delay is longer than all dates are apart."""
    items = jobs.read_stream(spark, d, views.table(spark, d, "lineitem").schema, "lineitem.parquet")
    rows = items.select(F.col("l_partkey").alias("prompt_id"), F.col("l_linenumber").alias("rollout_idx"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return jobs.drain(jobs.dedup(rows, ["prompt_id", "rollout_idx"], "20000 days"), "stream-dedup").drop("ts")


@query
def stream_rollout_log(spark, d):
    source = views.rollouts(spark, d)
    rows = jobs.read_stream(spark, staged_path(spark, d, "rollouts"), source.schema)
    log = jobs.drain(jobs.rollout_log(rows, step_of()), "stream-log", ["flush_step"])
    return log.groupBy("flush_step").agg(
        F.count(F.lit(1)).alias("num_samples"), F.count_if(F.col("answer") != "").alias("num_answers")
    )


# --- user functions and reports


@query
def reward_registry(spark, d):
    answers = views.answers(spark, d)
    return rewards.with_rewards(answers, ["ground_truth", "formatted"]).select(
        "prompt_id", "rollout_idx", "reward_ground_truth", "reward_formatted"
    )


@query
def map_prompts(spark, d):
    def to_prompt(df):
        return df.select(
            "id", P.student_prompt(F.col("problem"), "compact").alias("prompt"), F.col("answer").alias("Answer")
        )

    raw = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("Question"), F.col("p_size").alias("Answer")
    )
    return problem_sets.map_prompts(problem_sets.normalize_fields(raw, keep=["id"]), to_prompt)


def _scores(spark, d):
    method = F.element_at(F.array(F.lit("Base"), F.lit("Alpha"), F.lit("Beta")), (F.col("rollout_idx") % 3 + 1).cast("int"))
    return (
        views.graded(spark, d)
        .groupBy(
            F.concat(F.lit("model"), (F.floor(F.col("problem_id") / 5) % 2).cast("string")).alias("model"),
            method.alias("method"),
            F.col("dataset").alias("benchmark"),
        )
        .agg((F.avg(F.col("correct").cast("double")) * 100).alias("score"))
    )


@query
def leaderboard(spark, d):
    return reports.leaderboard(_scores(spark, d), BENCHES)


@query
def gain_over_base(spark, d):
    return reports.gain_over_base(_scores(spark, d))


@query
def best_per_benchmark(spark, d):
    return reports.best_per_benchmark(_scores(spark, d))


@query
def checkpoint_sweep(spark, d):
    number = F.col("rollout_idx") % 5
    scores = (
        views.graded(spark, d)
        .groupBy("dataset", F.when(number > 0, number * 25).alias("checkpoint"))
        .agg((F.avg(F.col("correct").cast("double")) * 100).alias("average_at_n_pct"))
    )
    return reports.checkpoint_sweep(scores)


@query
def cross_benchmark_gain(spark, d):
    trained = F.element_at(
        F.array(F.lit("Base"), F.lit("bench0"), F.lit("bench1"), F.lit("bench2")), (F.col("rollout_idx") % 4 + 1).cast("int")
    )
    scores = (
        views.graded(spark, d)
        .groupBy(trained.alias("trained_on"), F.col("dataset").alias("tested_on"))
        .agg((F.avg(F.col("correct").cast("double")) * 100).alias("score"))
    )
    return reports.cross_benchmark_gain(scores, BENCHES)
