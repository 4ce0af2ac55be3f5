"""Training rows: ordering, micro-batches, padded token arrays, masks and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolltally.config import BatchParams
from rolltally.functions import arrays as A
from rolltally.operators.ordering import numbered_all
from rolltally.operators.vote import PROMPT


def pad_to_batch(df: DataFrame, batch: list[str], ids: str, pad: int, max_length: int | None = None, out: str = "padded") -> DataFrame:
    """Cut to ``max_length``, then fill up to the longest of the batch; ``<out>_length`` keeps the true length.

    The longest is a combinable aggregate joined back, not a window over the batch.
    """
    cut = df.withColumn("_cut", A.truncate(F.col(ids), max_length) if max_length else F.col(ids))
    longest = cut.groupBy(*batch).agg(F.max(F.size("_cut")).alias("_longest"))
    return (
        cut.join(longest, batch)
        .withColumn(out, A.pad_right(F.col("_cut"), F.col("_longest"), pad))
        .withColumn(f"{out}_length", F.size("_cut"))
        .drop("_cut", "_longest")
    )


def rollout_major_order(selected: DataFrame, batch: list[str]) -> DataFrame:
    """``position = sel_rank * prompts + prompt_rank`` within each batch of prompts.

    A batch is the few prompts of one optimiser step, so ranking its prompts is a small window.
    """
    prompts = selected.select(*batch, *PROMPT).distinct()
    of_batch = Window.partitionBy(*batch)
    ranked = prompts.withColumn("prompt_rank", F.row_number().over(of_batch.orderBy(*PROMPT)) - 1).withColumn(
        "_prompts", F.count(F.lit(1)).over(of_batch)
    )
    return (
        selected.join(ranked, [*batch, *PROMPT])
        .withColumn("position", (F.col("sel_rank") * F.col("_prompts") + F.col("prompt_rank")).cast("bigint"))
        .drop("_prompts", "prompt_rank")
    )


def micro_batches(selected: DataFrame, params: BatchParams) -> DataFrame:
    """Optimiser step and micro-batch of every selected rollout, prompts taken in id order.

    Prompts are numbered over the whole table in sampled ranges of ids, not in a single-task window.
    """
    per_step = params.prompts_per_step
    prompts = numbered_all(selected.select(*PROMPT).distinct(), PROMPT, "prompt_rank")
    position = F.col("sel_rank") * per_step + F.col("prompt_rank") % per_step
    return (
        selected.join(prompts, PROMPT)
        .withColumn("step", F.floor(F.col("prompt_rank") / per_step).cast("bigint"))
        .withColumn("micro_batch", F.floor(position / params.batch).cast("bigint"))
    )


def training_set(
    selected: DataFrame,
    prompts: DataFrame,
    completions: DataFrame,
    batch: list[str],
    pad: int,
    max_tokens: int,
    max_length: int | None,
) -> DataFrame:
    """Ids, masks, labels, direction and advantage of every selected rollout in rollout-major order.

    ``prompts(prompt, student_ids, teacher_ids)``, ``completions(prompt, rollout_idx, token_ids)``. Labels hide
    the prompt's true length, then padding. One window over the few prompts of a batch gives their rank, number and
    padded lengths; prompts are padded before rollouts multiply them.
    """
    limit = A.prompt_limit(max_length, max_tokens)
    of_batch = Window.partitionBy(*batch)
    table = prompts.join(selected.select(*batch, *PROMPT).distinct(), PROMPT)
    for side in ("student", "teacher"):
        ids = F.col(f"{side}_ids")
        table = table.withColumn(f"{side}_ids", A.truncate(ids, limit) if limit else ids)
    table = table.select(
        *batch,
        *PROMPT,
        "student_ids",
        "teacher_ids",
        (F.row_number().over(of_batch.orderBy(*PROMPT)) - 1).alias("_rank"),
        F.count(F.lit(1)).over(of_batch).alias("_prompts"),
        F.max(F.size("student_ids")).over(of_batch).alias("_student"),
        F.max(F.size("teacher_ids")).over(of_batch).alias("_teacher"),
    ).select(
        *batch,
        *PROMPT,
        "_rank",
        "_prompts",
        F.size("student_ids").alias("_true_length"),
        A.pad_right(F.col("student_ids"), F.col("_student"), pad).alias("student_prompt"),
        A.pad_right(F.col("teacher_ids"), F.col("_teacher"), pad).alias("teacher_prompt"),
    )
    # Completions are cut before they meet the selection, so what crosses the exchange is bounded per rollout.
    completions = completions.select(*PROMPT, "rollout_idx", A.truncate(F.col("token_ids"), max_tokens).alias("token_ids"))
    rows = (
        selected.join(table, [*batch, *PROMPT])
        .withColumn("position", (F.col("sel_rank") * F.col("_prompts") + F.col("_rank")).cast("bigint"))
        .join(completions, [*PROMPT, "rollout_idx"])
    )
    answer = A.pad_truncate(F.col("token_ids"), max_tokens, pad)
    rows = rows.withColumn("student_input_ids", F.concat("student_prompt", answer)).withColumn(
        "teacher_input_ids", F.concat("teacher_prompt", answer)
    )
    return rows.select(
        *batch,
        *PROMPT,
        "rollout_idx",
        "position",
        "student_input_ids",
        A.attention_mask(F.col("student_input_ids"), pad).alias("student_attention_mask"),
        "teacher_input_ids",
        A.attention_mask(F.col("teacher_input_ids"), pad).alias("teacher_attention_mask"),
        A.label_mask(F.col("student_input_ids"), F.col("_true_length"), pad).alias("labels"),
        F.size("student_prompt").alias("student_prompt_width"),
        F.size("teacher_prompt").alias("teacher_prompt_width"),
        "direction_sign",
        "advantage",
    )
