import numpy as np
import pytest
from pyspark.sql import functions as F

from rolltally.config import LossParams
from rolltally.functions import vectors as V
from rolltally.operators import tokens as T

TAU, SIZE = 1.1, 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    rows = []
    for seq in range(3):
        for sample in range(4):
            # Sample 0 of sequence 0 holds a third of all tokens.
            for pos in range(60 if (seq, sample) == (0, 0) else rng.integers(1, 20)):
                token = int(rng.integers(0, SIZE))
                rows.append(
                    {
                        "seq_id": seq, "sample_id": sample, "pos": pos, "token_id": token, "label": -100 if rng.random() < 0.15 else token,
                        "direction_sign": 1 if sample % 2 else -1, "advantage": 1.5 if sample % 2 else -0.5,
                        "student": rng.normal(size=SIZE) * 4, "teacher": rng.normal(size=SIZE) * 4,
                    }
                )
    return rows


@pytest.fixture(scope="module")
def tokens(spark, data):
    schema = (
        "seq_id long, sample_id long, pos long, token_id long, label long, direction_sign int, advantage double, "
        "student array<double>, teacher array<double>"
    )
    rows = [tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in r.values()) for r in data]
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def softmax_log(x, tau=TAU):
    x = np.asarray(x) / tau
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def prepared(data):
    out = []
    for r in data:
        ls, lt = softmax_log(r["student"]), softmax_log(r["teacher"])
        f, b = np.exp(lt) * (lt - ls), np.exp(ls) * (ls - lt)
        out.append(
            r
            | {
                "ls": ls, "lt": lt, "ok": r["label"] != -100, "ent": -(np.exp(ls) * ls).sum(), "ent_t": -(np.exp(lt) * lt).sum(), "fkl": f.sum(),
                "rkl": b.sum(), "fklc": np.minimum(f, 0.05).sum(), "rklc": np.minimum(b, 0.05).sum(), "logp": ls[max(r["label"], 0)],
            }
        )
    for seq in {r["seq_id"] for r in out}:
        rows = [r for r in out if r["seq_id"] == seq]
        h, d = scale(rows, "ent"), scale(rows, "fkl")
        for r, a, b in zip(rows, h, d):
            r["h"], r["w"], r["score"] = a, a + b - a * b, -r["logp"] * (1 - a)
        median = np.quantile([r["score"] for r in rows if r["ok"]], 0.5)
        for r in rows:
            r["in"] = r["ok"] and r["score"] >= median - 1e-12
    return out


def scale(rows, name):
    valid = np.array([r[name] for r in rows if r["ok"]])
    top, low = np.quantile(valid, 0.98), valid.min()
    if top - low < 1e-8:
        return np.zeros(len(rows))
    return np.clip((np.minimum([r[name] for r in rows], top) - low) / (top - low), 0, 1)


@pytest.fixture(scope="module")
def spec_rows(data):
    return prepared(data)


@pytest.fixture(scope="module")
def scores(tokens):
    return T.token_scores(tokens).cache()


@pytest.fixture(scope="module")
def weighted(scores):
    return T.soft_or_weights(scores).cache()


def samples(rows):
    out = {}
    for r in rows:
        out.setdefault((r["seq_id"], r["sample_id"]), []).append(r)
    return out


@pytest.mark.parametrize("engine", ["arrow", "builtin"])
def test_scores(tokens, spec_rows, engine):
    scores = T.token_scores(tokens, engine=engine)
    got = {(r.seq_id, r.sample_id, r.pos): r for r in scores.collect()}
    for r in spec_rows:
        g = got[r["seq_id"], r["sample_id"], r["pos"]]
        assert [g.student_entropy, g.teacher_entropy, g.fkl, g.rkl, g.fkl_clipped, g.rkl_clipped, g.logp] == pytest.approx(
            [r["ent"], r["ent_t"], r["fkl"], r["rkl"], r["fklc"], r["rklc"], r["logp"]]
        )
        assert g.fkl >= -1e-12 and g.rkl >= -1e-12


@pytest.mark.parametrize("params", [LossParams(clip=None), LossParams(clip=0.5, clip_mode="token")])
def test_engines_agree_on_ragged_vectors(spark, params):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        n = int(rng.integers(1, 9))
        rows.append((0, 0, i, i % n, -100 if i % 5 == 0 else i % n, 1, 1.0, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()))
    schema = "seq_id long, sample_id long, pos long, token_id long, label long, direction_sign int, advantage double, student array<double>, teacher array<double>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    one, two = (T.token_scores(df, params, engine).orderBy("pos").toPandas() for engine in ("arrow", "builtin"))
    assert list(one.columns) == list(two.columns) and np.allclose(one.to_numpy(float), two.to_numpy(float))
    with pytest.raises(Exception, match="empty"):
        T.token_scores(df.withColumn("student", F.slice("student", 1, 0))).collect()


@pytest.mark.parametrize("beta", [0, 0.2, 0.5, 1])
@pytest.mark.parametrize("top_k", [None, 5])
def test_jsd(tokens, data, beta, top_k):
    rows = T.with_log_probs(tokens, TAU, top_k).select(
        "seq_id", "sample_id", "pos", V.total(V.jsd_terms(F.col("ls"), F.col("lt"), beta)).alias("v")
    )
    got = {(r.seq_id, r.sample_id, r.pos): r.v for r in rows.collect()}
    for r in data:
        keep = np.argsort(-r["teacher"], kind="stable")[: top_k or SIZE]
        s, t = softmax_log(r["student"][keep]), softmax_log(r["teacher"][keep])
        if beta in (0, 1):
            want = (np.exp(t) * (t - s)).sum() if beta == 0 else (np.exp(s) * (s - t)).sum()
        else:
            m = np.log((1 - beta) * np.exp(s) + beta * np.exp(t))
            want = beta * (np.exp(t) * (t - m)).sum() + (1 - beta) * (np.exp(s) * (s - m)).sum()
            assert got[r["seq_id"], r["sample_id"], r["pos"]] <= np.log(2) + 1e-9
        assert got[r["seq_id"], r["sample_id"], r["pos"]] == pytest.approx(want, abs=1e-10)


def test_extreme_scores_stay_finite(spark):
    df = spark.createDataFrame([([1000.0, -1000.0, 0.0], [-1000.0, 1000.0, 0.0])], "student array<double>, teacher array<double>")
    row = T.with_log_probs(df, 1.0).select(
        "ls", V.total(V.jsd_terms(F.col("ls"), F.col("lt"), 0.5)).alias("j"), V.entropy(F.col("ls")).alias("e")
    ).first()
    assert row.ls == pytest.approx([0.0, -2000.0, -1000.0]) and row.j == pytest.approx(np.log(2)) and row.e == pytest.approx(0.0)


def test_reductions(tokens, scores, weighted, spec_rows):
    ok = [r for r in spec_rows if r["ok"]]
    row = T.masked_reduction(tokens, 0, LossParams()).first()
    assert row.total == pytest.approx(sum(r["fklc"] for r in ok))
    assert row.batchmean == pytest.approx(row.total / len(ok)) and row["mean"] == pytest.approx(row.total / len(ok) / SIZE)
    for mode, first in ((-1, "fklc"), (-2, "rklc")):
        other = "rklc" if first == "fklc" else "fklc"
        per = [
            sum(r[first if r["direction_sign"] > 0 else other] for r in rows if r["ok"]) / max(1, sum(r["ok"] for r in rows))
            for rows in samples(spec_rows).values()
        ]
        assert T.loss(weighted, LossParams(kl_mode=mode, retention=1.0)).first().loss == pytest.approx(np.mean(per))
        soft = [
            sum(r["w"] * r[first if r["direction_sign"] > 0 else other] for r in rows if r["ok"]) / max(1, sum(r["ok"] for r in rows))
            for rows in samples(spec_rows).values()
        ]
        assert T.loss(weighted, LossParams(kl_mode=mode)).first().loss == pytest.approx(np.mean(soft))
    kl = {(r.seq_id, r.sample_id): r.kl_score for r in T.trajectory_kl(scores.where("pos > 2"), 6).collect()}
    for k, rows in samples([r for r in spec_rows if r["pos"] > 2]).items():
        early = [r["fkl"] for r in rows if r["pos"] < 6]
        assert kl[k] == pytest.approx(np.mean(early) if early else float("-inf"))


def test_weights_are_soft_or(weighted, spec_rows):
    got = {(r.seq_id, r.sample_id, r.pos): r.weight for r in weighted.collect()}
    for r in spec_rows:
        w = got[r["seq_id"], r["sample_id"], r["pos"]]
        assert 0 <= w <= 1 and w == pytest.approx(r["w"], abs=1e-9)


def test_flat_scores_scale_to_zero(scores):
    rows = T.quantile_minmax(scores.withColumn("flat", F.lit(2.5)), {"out": "flat"}).select("out").distinct().collect()
    assert [r.out for r in rows] == [0.0]


@pytest.mark.parametrize("most", [5, 10**6])
@pytest.mark.parametrize("retention", [0.01, 0.3])
def test_retained_tokens(weighted, spec_rows, most, retention):
    got = {(r.seq_id, r.sample_id, r.pos) for r in T.retained_tokens(weighted, retention, most).where("kept").collect()}
    want = set()
    for k, rows in samples([r for r in spec_rows if r["ok"]]).items():
        best = sorted(rows, key=lambda r: (-round(r["w"], 12), r["pos"]))[: max(1, int(len(rows) * retention))]
        want |= {(*k, r["pos"]) for r in best}
    assert got == want


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_retained_tokens_are_ranked(weighted, spec_rows, hot_rows):
    got = {(r.seq_id, r.sample_id, r.pos): r["rank"] for r in T.ranked_tokens(weighted, 0.3, 5, hot_rows).collect()}
    want = {}
    for k, rows in samples([r for r in spec_rows if r["ok"]]).items():
        best = sorted(rows, key=lambda r: (-round(r["w"], 12), r["pos"]))[: max(1, int(len(rows) * 0.3))]
        want |= {(*k, r["pos"]): i for i, r in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("mode,retention", [(-3, 0.0), (-4, 0.0), (-3, 0.3), (-3, 1.0)])
def test_hybrid_loss(weighted, spec_rows, mode, retention):
    params = LossParams(kl_mode=mode, retention=retention)
    masked = T.token_mask(weighted)
    rows = T.hybrid_samples(weighted, masked, params)
    got = {(r.seq_id, r.sample_id): r for r in rows.collect()}
    losses = []
    for k, part in samples(spec_rows).items():
        ok = [r for r in part if r["ok"]]
        n = max(1, len(ok))
        if retention == 0.0:
            kl = sum(r["fklc"] * r["w"] for r in ok) / n
        elif retention == 1.0:
            kl = sum(r["fklc"] for r in ok) / n
        else:
            best = sorted(ok, key=lambda r: (-round(r["w"], 12), r["pos"]))[: max(1, int(len(ok) * retention))]
            kl = sum(r["fklc"] for r in best) / max(1, len(best))
        pg = sum(-r["advantage"] * r["logp"] for r in ok if r["in"]) / n
        distil = (part[0]["direction_sign"] > 0) == (mode == -3)
        losses.append(kl if distil else 0.1 * pg)
        assert (got[k].kl_loss, got[k].pg_loss, got[k].loss) == pytest.approx((kl, pg, losses[-1]), abs=1e-9)
    assert T.hybrid_loss(rows).first().loss == pytest.approx(np.mean(losses))


@pytest.mark.parametrize("engine", ["arrow", "builtin"])
@pytest.mark.parametrize("beta", [0.0, 0.3, 0.5, 1.0])
def test_mixture_loss(tokens, spec_rows, beta, engine):
    params = LossParams(kl_mode=beta, retention=1.0)
    weighted = T.soft_or_weights(T.token_scores(tokens, params, engine))
    per = []
    for rows in samples(spec_rows).values():
        total = 0.0
        for r in rows:
            if r["ok"]:
                s, t = np.array(r["ls"]), np.array(r["lt"])
                if beta in (0, 1):
                    terms = np.exp(t) * (t - s) if beta == 0 else np.exp(s) * (s - t)
                else:
                    m = np.log((1 - beta) * np.exp(s) + beta * np.exp(t))
                    terms = beta * np.exp(t) * (t - m) + (1 - beta) * np.exp(s) * (s - m)
                total += np.minimum(terms, params.clip).sum()
        per.append(total / max(1, sum(r["ok"] for r in rows)))
    assert T.loss(weighted, params).first().loss == pytest.approx(np.mean(per), abs=1e-9)


def test_modes_are_not_mixed_up(weighted):
    with pytest.raises(ValueError, match="no hybrid mode"):
        T.hybrid_samples(weighted, None, LossParams(kl_mode=0.5))
    with pytest.raises(ValueError, match="mixes divergence"):
        T.divergence_loss(weighted, LossParams(kl_mode=-4))


def test_monitor_without_retention(weighted):
    row = T.weight_monitor(weighted, 0.0).first()
    assert row.kept_kl_mean is None and row.dropped_kl_mean is None and row.mean_weight > 0


def test_policy_terms(scores, spec_rows):
    ok = [r for r in spec_rows if r["ok"]]
    gain = [r["lt"][r["token_id"]] - r["ls"][r["token_id"]] for r in ok]
    row = T.sampled_advantage(scores).first()
    assert row.loss == pytest.approx(-np.mean([g * r["ls"][r["token_id"]] for g, r in zip(gain, ok)]))
    got = {(r.seq_id, r.sample_id): r.pg_loss for r in T.policy_gradient(scores).collect()}
    for k, rows in samples(ok).items():
        assert got[k] == pytest.approx(np.mean([-r["advantage"] * r["logp"] for r in rows]))


def test_bad_parameters():
    for bad in ({"clip_mode": "x"}, {"kl_mode": -5}, {"retention": 2}):
        with pytest.raises(ValueError):
            LossParams(**bad)
