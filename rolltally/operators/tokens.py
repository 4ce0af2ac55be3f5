"""Per-token statistics: divergences, weights, masks and the losses made of them.

Input is one row per token position. ``token_scores`` turns the two score vectors into a handful of
numbers in one pass; everything after it works on that narrow table, which should be staged because
batch-level percentiles read it more than once. Columns: ``seq_id`` = micro-batch, ``sample_id`` =
rollout within it, ``pos`` = position, ``label`` = token id or -100 where the loss looks away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.config import LossParams
from rolltally.functions import vectors as V
from rolltally.functions.arrays import IGNORE
from rolltally.functions.score_batches import SCORES, score_batches, top_k_batches
from rolltally.operators.ordering import HOT_ROWS, MOST_IN_A_TASK, mark_smallest, numbered
from rolltally.operators.quality import side_by_side
from rolltally.operators.quantiles import exact_percentiles

BATCH = ["seq_id"]
SAMPLE = ["seq_id", "sample_id"]
CARRIED = ["seq_id", "sample_id", "pos", "token_id", "label", "direction_sign", "advantage"]


def valid() -> Column:
    return F.col("label") != IGNORE


def with_log_probs(tokens: DataFrame, temperature: float, top_k: int | None = None) -> DataFrame:
    """Add ``ls`` and ``lt``, optionally over the teacher's ``top_k`` entries only.

    They are columns of their own projection, so later expressions read them instead of computing them again.
    """
    if top_k:
        tokens = tokens.mapInArrow(top_k_batches(top_k, tokens.columns), tokens.schema)
    return tokens.withColumn("ls", V.log_softmax(F.col("student"), temperature)).withColumn("lt", V.log_softmax(F.col("teacher"), temperature))


def token_scores(tokens: DataFrame, params: LossParams = LossParams(), engine: str = "arrow") -> DataFrame:
    """Entropies, divergences and sampled log-probabilities of every position.

    The one pass over the score vectors, and where the processor time goes. Ten figures from one pair of vectors
    cost built-in array functions some twenty sweeps with boxed values; numpy on Arrow batches measured four to six
    times faster at 64 and at 1,024 entries, so that is the default. ``builtin`` stays inside the JVM.
    """
    beta = params.kl_mode if 0 < params.kl_mode < 1 else None
    if engine == "arrow":
        kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
        names = SCORES + ["jsd_clipped"] * (beta is not None)
        schema = ", ".join([f"{c} {kinds[c]}" for c in CARRIED] + [f"{c} double" for c in names])
        run = score_batches(CARRIED, params.temperature, params.clip, params.clip_mode, beta)
        return tokens.select(*CARRIED, "student", "teacher").mapInArrow(run, schema)
    if engine != "builtin":
        raise ValueError("engine must be 'arrow' or 'builtin'")
    rows = with_log_probs(tokens, params.temperature)
    ls, lt = F.col("ls"), F.col("lt")
    fkl, rkl = V.forward_kl_terms(ls, lt), V.reverse_kl_terms(ls, lt)
    return rows.select(
        *CARRIED,
        V.entropy(ls).alias("student_entropy"),
        V.entropy(ls, 1e-10).alias("student_entropy_eps"),
        V.entropy(lt).alias("teacher_entropy"),
        V.total(fkl).alias("fkl"),
        V.total(rkl).alias("rkl"),
        V.clipped_sum(fkl, params.clip, params.clip_mode).alias("fkl_clipped"),
        V.clipped_sum(rkl, params.clip, params.clip_mode).alias("rkl_clipped"),
        V.sampled_logp(ls, F.col("label")).alias("logp"),
        V.sampled_logp(ls, F.col("token_id")).alias("student_logp"),
        V.sampled_logp(lt, F.col("token_id")).alias("teacher_logp"),
        *([V.clipped_sum(V.jsd_terms(ls, lt, beta), params.clip, params.clip_mode).alias("jsd_clipped")] if beta is not None else []),
    )


def entropy_report(scores: DataFrame, student: str = "student_entropy_eps") -> DataFrame:
    """Token-weighted entropy of student and teacher and their gap, over valid positions."""
    s, t = F.avg(student), F.avg("teacher_entropy")
    return scores.where(valid()).agg(
        s.alias("student_entropy"), t.alias("teacher_entropy"), (t - s).alias("entropy_gap"), F.count(F.lit(1)).alias("n_tokens")
    )


def masked_reduction(tokens: DataFrame, beta: float, params: LossParams, top_k: int | None = None) -> DataFrame:
    """Generalised divergence over valid tokens: per token, summed, and per vocabulary entry."""
    rows = with_log_probs(tokens.where(valid()), params.temperature, top_k)
    value = V.clipped_sum(V.jsd_terms(F.col("ls"), F.col("lt"), beta), params.clip, "element")
    summed = rows.select(value.alias("v"), F.size("ls").alias("entries"))
    return summed.agg(
        (F.sum("v") / F.count(F.lit(1))).alias("batchmean"),
        F.sum("v").alias("total"),
        (F.sum("v") / F.sum("entries")).alias("mean"),
    )


def divergence_of(params: LossParams) -> Column:
    """Clipped divergence of a position under ``kl_mode``: [0, 1] forward to reverse for all samples, -1 forward for the
    positive direction and reverse for the other, -2 the other way round. Other modes have no single divergence."""
    mode, positive = params.kl_mode, F.col("direction_sign") > 0
    if mode in (-1, -2):
        toward = positive if mode == -1 else ~positive
        return F.when(toward, F.col("fkl_clipped")).otherwise(F.col("rkl_clipped"))
    if mode == 0:
        return F.col("fkl_clipped")
    if mode == 1:
        return F.col("rkl_clipped")
    if 0 < mode < 1:
        return F.col("jsd_clipped")
    raise ValueError(f"kl_mode {mode} mixes divergence and policy gradient: use hybrid_samples")


def divergence_loss(weighted: DataFrame, params: LossParams) -> DataFrame:
    """Mean over samples of the token-weighted divergence, for the modes in [0, 1], -1 and -2; a sample without valid tokens counts as 0."""
    value = weighted.withColumn("_value", divergence_of(params))
    per = weighted.select(*SAMPLE).distinct().join(weighted_kl(value, params.retention, "_value"), SAMPLE, "left")
    return per.agg(F.avg(F.coalesce("kl_loss", F.lit(0.0))).alias("loss"), F.count(F.lit(1)).alias("n_samples"))


def loss(weighted: DataFrame, params: LossParams, masked: DataFrame | None = None) -> DataFrame:
    """The loss of any mode. ``masked`` (see ``token_mask``) is needed for the hybrid modes with token masking."""
    if params.kl_mode in (-3, -4):
        return hybrid_loss(hybrid_samples(weighted, masked, params))
    return divergence_loss(weighted, params)


def trajectory_kl(scores: DataFrame, max_tokens: int) -> DataFrame:
    """Mean forward divergence of a sample's first ``max_tokens`` positions; -inf without any."""
    mean = F.avg(F.when(F.col("pos") < max_tokens, F.col("fkl")))
    return scores.groupBy(*SAMPLE).agg(F.coalesce(mean, F.lit(float("-inf"))).alias("kl_score"))


def trajectory_logp(logprobs: Column) -> Column:
    """Mean of a rollout's log-probabilities; -inf for an empty list."""
    return F.when(F.size(logprobs) > 0, V.total(logprobs) / F.size(logprobs)).otherwise(F.lit(float("-inf")))


def quantile_minmax(scores: DataFrame, values: dict[str, str], q: float = 0.98, batch: list[str] = BATCH) -> DataFrame:
    """Scale columns to [0, 1] per micro-batch after cutting at percentile ``q``; 0 without spread.

    ``values``: new column -> source column. Limits come from valid positions and apply to all.
    """
    sources = sorted(set(values.values()))
    limits = exact_percentiles(scores.where(valid()), batch, sources, q)
    out = scores.join(limits, batch, "left")
    for name, source in values.items():
        top, low = F.col(f"{source}_at"), F.col(f"{source}_min")
        scaled = (F.least(F.col(source), top) - low) / (top - low)
        flat = top.isNull() | (top - low < 1e-8)
        out = out.withColumn(
            name, F.when(flat, 0.0).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
        )
    return out.drop(*[f"{source}{part}" for source in sources for part in ("_at", "_min")])


def soft_or_weights(scores: DataFrame, q: float = 0.98) -> DataFrame:
    """``weight = h + d - h*d`` of scaled student entropy and scaled positive divergence.

    Written as ``1 - (1-h)*(1-d)``, which is exactly 1 wherever one side is, so that ranking sees true ties.
    """
    rows = scores.withColumn("_delta", F.greatest(F.col("fkl"), F.lit(0.0)))
    scaled = quantile_minmax(rows, {"h_hat": "student_entropy", "d_hat": "_delta"}, q)
    h, d = F.col("h_hat"), F.col("d_hat")
    return scaled.withColumn("weight", 1 - (1 - h) * (1 - d)).drop("_delta")


def retained_tokens(weighted: DataFrame, retention: float, most: int = MOST_IN_A_TASK) -> DataFrame:
    """Mark the ``floor(valid * retention)`` (at least one) highest-weighted valid tokens of each sample, the first of equal ones.

    The number kept grows with the sample, so it is no constant bound; a threshold is found by histograms, and only tokens next to it are ranked.
    """
    rows = weighted.where(valid())
    kept = F.greatest(F.floor(F.count(F.lit(1)) * retention), F.lit(1))
    return mark_smallest(rows, SAMPLE, [-F.col("weight"), F.col("pos")], kept, "kept", most)


def ranked_tokens(weighted: DataFrame, retention: float, most: int = MOST_IN_A_TASK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The retained tokens of each sample with their 0-based ``rank``: highest weight first, the first of equal ones.

    Samples that retain more than ``hot_rows`` tokens are ranked block by block: blocks follow the weight, and where many tokens share a limit (0 or 1) the position.
    """
    w, pos = F.col("weight"), F.col("pos")
    slot = F.when(w >= 1, -1).when(w <= 0, 4097).otherwise(F.floor((1 - w) * 4096))
    block = [slot, F.when((w >= 1) | (w <= 0), F.floor(pos / (1 << 16))).otherwise(0)]
    kept = retained_tokens(weighted, retention, most).where("kept")
    return numbered(kept, SAMPLE, [w.desc(), pos.asc()], block, "rank", hot_rows)


def weighted_kl(weighted: DataFrame, retention: float, value: str = "fkl_clipped") -> DataFrame:
    """Per-sample divergence: plain mean (1), weighted over all valid tokens (0) or mean of the top share."""
    kl, n = F.col(value), F.greatest(F.count(F.lit(1)), F.lit(1))
    if 0 < retention < 1:
        top = retained_tokens(weighted, retention).where("kept")
        return top.groupBy(*SAMPLE).agg((F.sum(kl) / F.count(F.lit(1))).alias("kl_loss"))
    term = kl if retention >= 1 else kl * F.col("weight")
    return weighted.where(valid()).groupBy(*SAMPLE).agg((F.sum(term) / n).alias("kl_loss"))


def weight_monitor(weighted: DataFrame, retention: float, value: str = "fkl_clipped") -> DataFrame:
    """Share of low weights, mean weight, and mean divergence of kept and dropped tokens (null at retention 0, which drops none)."""
    marked = retained_tokens(weighted, retention)
    kl = F.col(value) if retention > 0 else F.lit(None).cast("double")
    return marked.agg(
        F.avg((F.col("weight") < 0.1).cast("double")).alias("low_weight_share"),
        F.avg("weight").alias("mean_weight"),
        F.avg(F.when(F.col("kept"), kl)).alias("kept_kl_mean"),
        F.avg(F.when(~F.col("kept"), kl)).alias("dropped_kl_mean"),
    )


def policy_gradient(scores: DataFrame) -> DataFrame:
    """Per-sample mean of ``-advantage * logp`` over valid tokens."""
    term = -F.col("advantage") * F.col("logp")
    return scores.where(valid()).groupBy(*SAMPLE).agg(F.avg(term).alias("pg_loss"))


def token_mask(scores: DataFrame, q: float = 0.98) -> DataFrame:
    """Keep valid tokens whose ``-logp * (1 - scaled entropy)`` reaches the micro-batch median.

    ``soft_or_weights`` output already has the scaled entropy as ``h_hat``; it is computed only where missing.
    """
    scaled = scores if "h_hat" in scores.columns else quantile_minmax(scores, {"h_hat": "student_entropy"}, q)
    scored = scaled.withColumn("mask_score", -F.col("logp") * (1 - F.col("h_hat")))
    median = exact_percentiles(scored.where(valid()), BATCH, ["mask_score"], 0.5)
    reached = F.coalesce(F.col("mask_score") >= F.col("mask_score_at"), F.lit(False))
    return scored.join(median, BATCH, "left").withColumn("masked_in", valid() & reached).drop("mask_score_at", "mask_score_min")


def masked_policy_gradient(masked: DataFrame) -> DataFrame:
    """Per-sample policy-gradient term of the tokens masked in, over all valid tokens."""
    term = F.when(F.col("masked_in"), -F.col("advantage") * F.col("logp")).otherwise(0.0)
    return masked.where(valid()).groupBy(*SAMPLE).agg((F.sum(term) / F.count(F.lit(1))).alias("pg_loss"))


def hybrid_samples(weighted: DataFrame, masked: DataFrame | None, params: LossParams) -> DataFrame:
    """Per sample: direction, divergence loss, policy-gradient loss and the one that counts, for the modes -3 and -4."""
    if params.kl_mode not in (-3, -4):
        raise ValueError(f"kl_mode {params.kl_mode} is no hybrid mode: use divergence_loss")
    signs = weighted.groupBy(*SAMPLE).agg(F.first("direction_sign").alias("direction_sign"))
    kl = weighted_kl(weighted, params.retention)
    pg = masked_policy_gradient(masked) if params.use_token_masking else policy_gradient(weighted)
    rows = signs.join(kl, SAMPLE, "left").join(pg, SAMPLE, "left").fillna(0.0, ["kl_loss", "pg_loss"])
    distil = (F.col("direction_sign") > 0) if params.kl_mode == -3 else ~(F.col("direction_sign") > 0)
    return rows.withColumn(
        "loss", F.when(distil, F.col("kl_loss")).otherwise(F.lit(params.rl_weight) * F.col("pg_loss"))
    )


def hybrid_loss(samples: DataFrame) -> DataFrame:
    """Mean of the per-sample losses."""
    return samples.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_samples"))


def branch_monitor(samples: DataFrame, masked: DataFrame, params: LossParams) -> DataFrame:
    """For the modes -3 and -4: unweighted mean loss of each direction, and mean log-probability of masked-in and of all negative tokens."""
    positive, negative = F.col("direction_sign") > 0, F.col("direction_sign") < 0
    pos_loss, neg_loss = ("kl_loss", "pg_loss") if params.kl_mode == -3 else ("pg_loss", "kl_loss")
    losses = samples.agg(
        F.coalesce(F.avg(F.when(positive, F.col(pos_loss))), F.lit(0.0)).alias("loss_pos"),
        F.coalesce(F.avg(F.when(negative, F.col(neg_loss))), F.lit(0.0)).alias("loss_neg"),
    )
    logps = masked.where(valid() & negative).agg(
        F.avg(F.when(F.col("masked_in"), F.col("logp"))).alias("selected_logp_mean"), F.avg("logp").alias("all_logp_mean")
    )
    return side_by_side(losses, logps)


def sampled_advantage(scores: DataFrame) -> DataFrame:
    """Advantage of the sampled token under the teacher: mean, and the loss ``-(A * student logp)``."""
    gain = F.col("teacher_logp") - F.col("student_logp")
    return scores.where(valid()).agg(
        F.avg(gain).alias("advantage_mean"), (-F.avg(gain * F.col("student_logp"))).alias("loss")
    )
