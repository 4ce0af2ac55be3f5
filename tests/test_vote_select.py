import itertools
import random

import pytest
from pyspark.sql import functions as F

import spec
from rolltally.config import BatchParams, SelectParams, VoteParams
from rolltally.functions.answers import answer_key
from rolltally.operators import evaluation, quality, rewards, select, vote
from rolltally.operators.assemble import micro_batches, rollout_major_order

NOTATIONS = ["{0}", "{0}.0", " {0}", "{1}:2", "\\frac{{{1}}}{{2}}"]
SCHEMA = "prompt_id long, rollout_idx long, n_tokens long, kl_score double, logp_score double, ground_truth string, answer string"


def make_rows(seed=1, prompts=40, most=14):
    rng = random.Random(seed)
    rows = []
    for p in range(prompts):
        # Prompt 0 holds a third of all rows.
        size = prompts * most // 3 if p == 0 else rng.randint(1, most)
        spread = rng.choice([1, 2, 4])
        for k in range(size):
            v = rng.randint(0, spread)
            text = rng.choice(NOTATIONS).format(v, 2 * v)
            answer = rng.choice([text] * 6 + [None, "", rng.choice(["E", "e ", "x"])])
            rows.append(
                {
                    "prompt_id": p * 3, "rollout_idx": k, "n_tokens": rng.randint(1, 6), "kl_score": rng.randint(0, 3) / 2,
                    "logp_score": rng.choice([float("-inf"), -1.0, -0.5]), "ground_truth": rng.choice(["0", "1", None, ""]) if k == 0 else None,
                    "answer": answer,
                }
            )
            if k:
                rows[-1]["ground_truth"] = rows[-1 - k]["ground_truth"]
    return rows


ROWS = make_rows()


def grouped(rows):
    return {p: list(g) for p, g in itertools.groupby(rows, key=lambda r: r["prompt_id"])}


@pytest.fixture(scope="module")
def answers(spark):
    shuffled = ROWS[:]
    random.Random(3).shuffle(shuffled)
    df = spark.createDataFrame([tuple(r.values()) for r in shuffled], SCHEMA).repartition(7)
    return df.withColumn("answer_key", answer_key(F.col("answer"))).cache()


@pytest.fixture(scope="module")
def votes(answers):
    return vote.majority_vote(answers).cache()


def test_vote_equals_brute_force(votes):
    got = {r.prompt_id: (r.pseudo_label, r.consensus_count, r.n_rollouts) for r in votes.collect()}
    want = {}
    for p, rows in grouped(ROWS).items():
        label, _, count = spec.vote([r["answer"] for r in rows])
        want[p] = (label, count, len(rows))
    assert got == want


@pytest.mark.parametrize(
    "texts,label,count",
    [
        ([None, "", None], None, 0),
        (["10", "7", "10", "7"], "7", 2),
        (["ab", "cd"], "ab", 1),
        (["4.0", "8:2", "5", "\\frac{8}{2}"], "4.0", 3),
    ],
)
def test_vote_ties(spark, texts, label, count):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "prompt_id long, rollout_idx long, answer string")
    row = vote.majority_vote(df.withColumn("answer_key", answer_key(F.col("answer")))).first()
    assert (row.pseudo_label, row.consensus_count, row.n_rollouts) == (label, count, len(texts))


def test_quotas_equal_list_spec(spark):
    cases = [(p, n) for p in range(0, 13) for n in range(0, 13) if p + n]
    base = spark.createDataFrame(cases, "consensus_count long, n_neg0 long").selectExpr(
        "consensus_count", "consensus_count + n_neg0 as n_rollouts", "n_neg0", "'a' as pseudo_label"
    )
    for k in (1, 2, 3, 5, 8):
        for fraction in (-1, 0.0, 0.1, 0.3, 0.5, 0.9, 1.0):
            rows = select.class_quotas(base, VoteParams(0), SelectParams(k, fraction)).collect()
            for r in rows:
                pos, neg = [1] * r.consensus_count, [0] * r.n_neg0
                got = spec.picks(pos, neg, k, fraction)
                assert (r.take_pos, r.take_neg) == (sum(got), len(got) - sum(got)), (k, fraction, r)


@pytest.mark.parametrize("fraction", [0.5, 0.25, 1.0, 0.0, -1, -2])
@pytest.mark.parametrize("strategies", [(0, 0), (1, 3), (2, 0), (3, 1), (9, 2)])
def test_selection_equals_brute_force(answers, votes, fraction, strategies):
    params = SelectParams(4, fraction, *strategies)
    got = {}
    for r in select.select_rollouts(answers, votes, VoteParams(3), params).orderBy("prompt_id", "sel_rank").collect():
        got.setdefault(r.prompt_id, []).append((r.rollout_idx, r.direction_sign))
    want = {p: spec.select(rows, 4, fraction, *strategies, 3) for p, rows in grouped(ROWS).items()}
    assert got == want


def test_vote_metrics_equal_brute_force(spark, answers, votes):
    problems = spark.createDataFrame(
        [(p, rows[0]["ground_truth"]) for p, rows in grouped(ROWS).items()], "prompt_id long, ground_truth string"
    )
    chosen = select.select_rollouts(answers, votes, VoteParams(3), SelectParams(4, 0.5))
    groups = quality.clusters(answers)
    got = quality.rollout_accuracy(groups, votes, problems).first()
    neither = quality.wrong_label_neither(groups, votes, problems).first()
    signal = quality.signal_accuracy(answers, groups, votes, chosen, problems, 3).first()
    right = answered = solved = known = vote_ok = vote_n = miss = miss_n = sig = sig_n = up = up_n = 0
    for p, rows in grouped(ROWS).items():
        truth = rows[0]["ground_truth"]
        if not truth:
            continue
        label, label_key, count = spec.vote([r["answer"] for r in rows])
        agreed = count >= 3 and bool(label)
        hit = lambda r: bool(r["answer"]) and spec.key(r["answer"]) == spec.key(truth)
        known += 1
        solved += any(map(hit, rows))
        right += sum(map(hit, rows))
        answered += sum(1 for r in rows if r["answer"])
        if label:
            vote_n += 1
            vote_ok += label_key == spec.key(truth)
            if label_key != spec.key(truth):
                miss_n += len(rows)
                miss += sum(1 for r in rows if not r["answer"] or (spec.key(r["answer"]) not in (label_key, spec.key(truth))))
        best = min((r for r in rows if r["answer"]), key=lambda r: r["n_tokens"], default=None)
        for r in rows:
            sign = (bool(r["answer"]) and spec.key(r["answer"]) == label_key) if agreed else r is best
            sig += sign == hit(r)
            sig_n += 1
        for idx, sign in spec.select(rows, 4, 0.5, 0, 0, 3):
            up += (sign > 0) == hit(rows[idx])
            up_n += 1
    assert got.rollout_accuracy == pytest.approx(right / answered)
    assert got.vote_accuracy == pytest.approx(vote_ok / vote_n)
    assert got.pass_at_k == pytest.approx(solved / known)
    assert (neither.neither, neither.total) == (miss, miss_n)
    assert signal.signal_accuracy == pytest.approx(sig / sig_n)
    assert signal.update_signal_accuracy == pytest.approx(up / up_n)


def test_sharded_sums_equal_the_whole(answers):
    whole = quality.combine_shards(quality.shard_sums(answers, F.lit(0))).first()
    parts = quality.combine_shards(quality.shard_sums(answers, F.col("rollout_idx") % 5)).first()
    assert whole == parts


def test_ground_truth_routing_needs_truth(spark, answers):
    with pytest.raises(Exception, match="ground-truth answer"):
        vote.route_ground_truth(answers).collect()
    routed = vote.route_ground_truth(answers.withColumn("ground_truth", F.lit("1")))
    got = {r.prompt_id: r.consensus_count for r in routed.collect()}
    assert got == {p: sum(spec.key(r["answer"]) == 1 for r in rows) for p, rows in grouped(ROWS).items()}


def test_truth_routing_without_a_match_is_all_negative(spark, answers):
    routed = vote.route_ground_truth(answers.withColumn("ground_truth", F.lit("77")))
    rows = select.select_rollouts(answers, routed, VoteParams(use_ground_truth=True), SelectParams(4, 0.5))
    assert {r.direction_sign for r in rows.collect()} == {-1}


def test_advantages(spark):
    df = spark.createDataFrame([(1, 3, 8), (-1, 3, 8), (1, 1, 8), (-1, 8, 8)], "direction_sign int, consensus_count long, n_rollouts long")
    got = [r.advantage for r in rewards.advantages(df, 2).collect()]
    mean, std = 3 / 8, (3 / 8 * 5 / 8) ** 0.5
    assert got == pytest.approx([(1 - mean) / (std + 1e-6), -mean / (std + 1e-6), 1.0, -1.0])


def test_semi_and_anti_join_are_complements(spark, answers):
    problems = answers.select("prompt_id", "ground_truth").distinct()
    hit, miss = vote.matching(answers, problems).count(), vote.not_matching(answers, problems).count()
    assert hit + miss == answers.count() and hit > 0 and miss > 0


def test_reward_registry(answers):
    rewards.register_reward("long", lambda limit=3: (F.col("n_tokens") > limit).cast("double"))
    rows = rewards.with_rewards(answers, ["long", "formatted"]).collect()
    assert all(r.reward_long == float(r.n_tokens > 3) and r.reward_formatted == float(bool(r.answer)) for r in rows)
    with pytest.raises(ValueError, match="unknown reward"):
        rewards.reward_column("nope")


def test_teacher_privilege_modes(spark, answers, votes):
    chosen = select.select_rollouts(answers, votes, VoteParams(3), SelectParams(4, 0.5))
    texts = answers.select("prompt_id", "rollout_idx", F.concat(F.lit("t"), "rollout_idx").alias("completion"))
    got = {r.prompt_id: r.privilege for r in select.teacher_privilege(chosen, texts, "trajectory").collect()}
    for p, rows in grouped(ROWS).items():
        good = [rows[i] for i, s in spec.select(rows, 4, 0.5, 0, 0, 3) if s == 1]
        want = f"t{min(good, key=lambda r: r['n_tokens'])['rollout_idx']}" if good else spec.vote([r["answer"] for r in rows])[0] or ""
        assert got[p] == want
    assert {r.privilege for r in select.teacher_privilege(chosen, texts, "none").collect()} == {None}


def test_orders_and_micro_batches(spark):
    rows = [(p, k) for p in (5, 9, 70000, 140001) for k in range(4)]
    df = spark.createDataFrame(rows, "prompt_id long, sel_rank long").withColumn("rollout_idx", F.col("sel_rank"))
    params = BatchParams(batch=2, accumulation=4, k_train=4)
    assert params.prompts_per_step == 2
    got = {(r.prompt_id, r.sel_rank): (r.step, r.micro_batch) for r in micro_batches(df, params, 1 << 10).collect()}
    for i, p in enumerate((5, 9, 70000, 140001)):
        for k in range(4):
            assert got[p, k] == (i // 2, (k * 2 + i % 2) // 2)
    order = rollout_major_order(df.withColumn("step", F.lit(0)), ["step"]).orderBy("position").collect()
    assert [(r.prompt_id, r.sel_rank) for r in order] == [(p, k) for k in range(4) for p in (5, 9, 70000, 140001)]
    with pytest.raises(ValueError, match="divisible"):
        BatchParams(batch=1, accumulation=3, k_train=8).prompts_per_step


def test_vote_by_text_merges_sources(spark):
    rows = [(1, 0, "p", "2", None), (1, 1, "p", "3", "9"), (2, 0, "p", "3.0", "3"), (3, 0, "q", None, "1")]
    df = spark.createDataFrame(rows, "prompt_id long, rollout_idx long, problem string, answer string, ground_truth string")
    got = vote.vote_by_text(df.withColumn("answer_key", answer_key(F.col("answer"))), "problem", ["prompt_id", "rollout_idx"])
    assert {(r.problem, r.pseudo_label, r.consensus_count, r.n_rollouts, r.ground_truth) for r in got.collect()} == {
        ("p", "3", 2, 3, None), ("q", None, 0, 1, "1"),
    }


def test_evaluation_placeholder_votes_and_empty_boxes(spark):
    rows = [("d", 1, 0, ""), ("d", 1, 1, ""), ("d", 1, 2, "5"), ("d", 1, 3, None), ("d", 2, 0, None)]
    df = spark.createDataFrame(rows, "dataset string, problem_id long, rollout_idx long, answer string").withColumn("ground_truth", F.lit("5.0"))
    graded = evaluation.grade(df.withColumn("answer_key", answer_key(F.col("answer"))))
    got = {r.problem_id: r for r in evaluation.per_problem(graded).collect()}
    assert (got[1].num_correct, got[1].num_formatted, got[1].pass_at_n, got[1].majority_vote_correct) == (1, 3, True, False)
    assert got[1].predicted_answer == "[No boxed answer found]" and got[1].formatted and not got[2].formatted
    assert not got[2].majority_vote_correct and got[2].num_formatted == 0
    flat = evaluation.generations(graded.withColumn("completion", F.lit("c")))
    assert sorted((r.problem_id, r.rollout_idx) for r in flat.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]


def test_report_of_a_problem_with_many_samples(spark):
    """One row per problem, however many generations it has."""
    rows = [("d", "p", i, "\\boxed{5}" if i % 3 else "none", "text", "5") for i in range(600)]
    rows = spark.createDataFrame(rows, "dataset string, problem_id string, rollout_idx long, completion string, problem string, ground_truth string")
    texts = evaluation.graded_texts(rows)
    got = evaluation.report(evaluation.per_problem(texts), texts).collect()
    assert len(got) == 1 and got[0].val_n == 600 and got[0].num_correct == 400
    assert (got[0].problem, got[0].ground_truth, got[0].full_generation, got[0].formatted) == ("text", "5", "none", False)
    assert evaluation.generations(texts).count() == 600


def test_repairs_vote_with_the_others(spark):
    rows = [(1, 0, "\\boxed{2}", None), (1, 1, "cut off", "6/2}}"), (1, 2, "cut off", " 3 }"), (1, 3, "cut off", " }"), (1, 4, "\\boxed{2}", "9}")]
    df = spark.createDataFrame(rows, "prompt_id long, rollout_idx long, completion string, continuation string")
    answers = vote.with_repairs(vote.with_answers(df))
    assert "continuation" not in answers.columns
    got = {r.rollout_idx: (r.answer, r.answer_key, r.extracted, r.recovered) for r in answers.collect()}
    assert got[1] == ("6/2", "n:3.000000", False, True) and got[2][1] == "n:3.000000" and got[3] == (None, None, False, False)
    assert got[4] == ("2", "n:2.000000", True, False)
    assert vote.majority_vote(answers).first().consensus_count == 2
    rates = vote.repair_rates(answers).first()
    assert (rates.extraction_rate, rates.recovery_rate, rates.answer_rate) == (0.4, pytest.approx(2 / 3), 0.8)
