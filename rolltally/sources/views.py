"""Rollouts, token scores and step logs derived from the star-schema tables.

The tables hold no model output, so these views give them that shape, row for row: a part is a
prompt and each of its line items a rollout, an embedding is a token position with its successor as the
teacher's view, an event is a logged metric value. All rows are used. Each view is staged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.config import LossParams
from rolltally.functions.answers import answer_key
from rolltally.operators import tokens as T
from rolltally.operators.evaluation import grade
from rolltally.operators.ordering import numbered
from rolltally.operators.vote import with_answers, with_repairs, with_texts
from rolltally.sources.staging import staged

B = "\\boxed{"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prompt_id, problem, ground_truth``; some truths are null and some empty."""
    size = F.col("p_size")
    truth = F.when(size % 11 == 0, None).when(size % 11 == 1, "").otherwise((size % 7).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("problem"), truth.alias("ground_truth")
    )


ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
ITEM = [*ORDER, "l_partkey", "l_quantity", "l_discount", "l_tax"]


#: Answers that are no numbers, by ``a``: two ways of writing one term, but two terms for 2.
TERMS = {5: ("x+1", "X + 1"), 4: (r"1+\sqrt{2}", r"\sqrt{2} + 1"), 3: (r"\frac{x}{2}", "0.5x"), 2: (r"\pi^2", r"\frac{1}{\pi}")}


def written(n: Column, pre: Column, plain: Column) -> Column:
    out = plain
    for a, forms in TERMS.items():
        form = F.when(n == 1, F.lit(forms[0])).otherwise(F.lit(forms[1]))
        out = F.when(F.col("a") == a, F.concat(pre, form, F.lit("} done"))).otherwise(out)
    return out


def rollouts_of(items: DataFrame, keep: list[str]) -> DataFrame:
    """Completions with seven notations of an answer, terms written in two ways each, a decoy before the end of thinking, two ways of missing."""
    a = F.floor("l_quantity") % 5 + F.col("l_suppkey") % 2
    v = (F.col("l_suppkey") * 3 + F.col("l_linenumber") + F.col("l_orderkey")) % 10
    text = lambda c: c.cast("string")
    pre = F.concat(F.lit("work " + B), text(F.col("a") + 1), F.lit("} so</think> ans " + B))
    plain = F.concat(pre, text(F.col("a")), F.lit("} done"))
    n, double_a = F.col("v"), text(F.col("a") * 2)
    completion = (
        F.when(n == 0, plain)
        .when(n.isin(1, 2), written(n, pre, plain))
        .when(n == 3, F.concat(pre, F.lit(" "), text(F.col("a")), F.lit(".0 } done")))
        .when(n == 4, F.concat(pre, F.lit("\\frac{"), double_a, F.lit("}{2}} done")))
        .when(n == 5, F.concat(pre, double_a, F.lit(":2} done")))
        .when(n == 6, F.lit("work so"))
        .when(n == 7, F.concat(pre, text(F.col("a"))))
        .when(n == 8, F.concat(pre, F.lit("} done")))
        .otherwise(F.concat(pre, text(F.col("a")), F.lit("} or " + B), text(F.col("a") + 2), F.lit("} end")))
    )
    line = F.col("l_linenumber")
    forced = F.when(line % 3 == 0, F.concat(text(F.col("a")), F.lit("}}"))).when(line % 3 == 1, F.lit(" }"))
    logprobs = F.slice(
        F.array(-F.col("l_discount") * 10, -F.col("l_tax") * 10, -(F.col("l_discount") + F.col("l_tax"))),
        F.lit(1),
        ((F.col("l_orderkey") + line) % 4).cast("int"),
    )
    return (
        items.withColumn("a", a)
        .withColumn("v", v)
        .select(
            F.col("l_partkey").alias("prompt_id"),
            *keep,
            (F.floor("l_extendedprice") % 1500).alias("n_tokens"),
            (F.col("l_discount") * 7 + F.col("l_tax")).alias("kl_score"),
            logprobs.alias("logprobs"),
            forced.alias("continuation"),
            completion.alias("completion"),
        )
    )


def build_rollouts(spark: SparkSession, sf_dir: str, hot_rows: int = 1 << 20) -> DataFrame:
    """Items are numbered and meet their problem while narrow, in one exchange; the texts are made after it."""
    items = table(spark, sf_dir, "lineitem").select(*ITEM)
    block = F.floor(F.col("l_orderkey") / (1 << 16))
    numbers = numbered(items, ["l_partkey"], ORDER, block, "rollout_idx", hot_rows)
    rows = numbers.join(problems(spark, sf_dir).withColumnRenamed("prompt_id", "l_partkey"), "l_partkey")
    made = rollouts_of(rows, ["rollout_idx", "problem", "ground_truth"])
    return made.select(*[c for c in made.columns if c not in ("problem", "ground_truth")], "problem", "ground_truth")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prompt_id, rollout_idx, n_tokens, kl_score, logprobs, continuation, completion, problem, ground_truth``."""
    return staged(spark, sf_dir, "rollouts", lambda: build_rollouts(spark, sf_dir))


ANSWER_COLUMNS = [
    "prompt_id", "rollout_idx", "n_tokens", "kl_score", "logp_score", "ground_truth", "answer", "answer_key", "extracted", "recovered"
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow table voting and selection work on: completions read once, then left behind; repaired before any vote."""

    def build() -> DataFrame:
        rows = rollouts(spark, sf_dir).withColumn("logp_score", T.trajectory_logp(F.col("logprobs")))
        repaired = with_repairs(with_texts(rows))
        return repaired.withColumn("answer_key", answer_key(F.col("answer"))).select(*ANSWER_COLUMNS)

    return staged(spark, sf_dir, "answers", build)


def eval_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as samples of five benchmarks."""
    return rollouts(spark, sf_dir).select(
        F.concat(F.lit("bench"), (F.col("prompt_id") % 5).cast("string")).alias("dataset"),
        F.col("prompt_id").alias("problem_id"),
        "prompt_id",
        "rollout_idx",
        "completion",
        "problem",
        "ground_truth",
    )


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation answers with their grades, without the texts."""
    return staged(
        spark, sf_dir, "graded", lambda: grade(with_answers(eval_rollouts(spark, sf_dir), rule="last"))
    )


def build_tokens(spark: SparkSession, sf_dir: str, hot_rows: int = 1 << 20) -> DataFrame:
    """Every vector is a position. Its teacher is the vector of the next id; one without a successor takes the first vector of the table."""
    vectors = table(spark, sf_dir, "embeddings")
    scaled = lambda name: F.transform(F.col(name), lambda x: x.cast("double") * 20)
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), scaled("embedding").alias("next"))
    first = vectors.agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.lit(0).alias("_one"), scaled("embedding").alias("first"))
    rows = vectors.select("vec_id", F.col("label").alias("seq_id"), scaled("embedding").alias("student"), F.lit(0).alias("_one"))
    rows = rows.join(following, "vec_id", "left").join(first, "_one").withColumn("teacher", F.coalesce("next", "first"))
    sample = F.col("vec_id") % 4
    rows = rows.drop("_one", "next", "first").withColumn("sample_id", sample)
    block = F.floor(F.col("vec_id") / 4096)
    rows = numbered(rows, ["seq_id", "sample_id"], ["vec_id"], block, "pos", hot_rows)
    return rows.select(
        F.col("seq_id").cast("bigint").alias("seq_id"),
        "sample_id",
        "pos",
        (F.col("vec_id") % 64).alias("token_id"),
        F.when(F.col("pos") % 9 == 0, -100).otherwise(F.col("vec_id") % 64).cast("bigint").alias("label"),
        F.when(sample % 2 == 0, 1).otherwise(-1).alias("direction_sign"),
        F.when(sample % 2 == 0, 1.5).otherwise(-0.5).alias("advantage"),
        "student",
        "teacher",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token positions with student and teacher score vectors of 64 entries."""
    return staged(spark, sf_dir, "tokens", lambda: build_tokens(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str, params: LossParams = LossParams()) -> DataFrame:
    """Numbers per token position, the input of every batch-level statistic."""
    name = f"scores-{params.clip}-{params.clip_mode}" + (f"-{params.kl_mode}" if 0 < params.kl_mode < 1 else "")
    return staged(spark, sf_dir, name, lambda: T.token_scores(tokens(spark, sf_dir), params))


def weighted(spark: SparkSession, sf_dir: str, params: LossParams = LossParams()) -> DataFrame:
    name = "weighted" + (f"-{params.kl_mode}" if 0 < params.kl_mode < 1 else "")
    return staged(spark, sf_dir, name, lambda: T.soft_or_weights(scores(spark, sf_dir, params)))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "masked", lambda: T.token_mask(weighted(spark, sf_dir)))


def cents() -> Column:
    """Metric value of an event in whole hundredths, so that sums are exact whatever the order of addition."""
    return F.round(F.col("value") * 100).alias("value")


def build_steps(spark: SparkSession, sf_dir: str, hot_rows: int = 1 << 20) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("name"), cents())
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rows = numbered(events, ["user_id"], ["ts", "event_id"], block, "step", hot_rows)
    return rows.withColumn("step", F.col("step") + 1)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a step log per user: ``user_id, event_id, ts, name, value, step`` (from 1)."""
    return staged(spark, sf_dir, "steps", lambda: build_steps(spark, sf_dir))


def ids_of(text: Column) -> Column:
    """Stand-in token ids of a text: one per word, its length plus the code of its first character."""
    return F.transform(F.split(text, " "), lambda w: (F.length(w) + F.ascii(w)).cast("int"))

