"""Run manifests and report keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_checkpoint(manifest: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """Path with the highest number after ``checkpoint-`` per run; other paths are ignored."""
    number = F.regexp_extract(F.col(path), r"checkpoint-(\d+)/?$", 1).try_cast("bigint")
    numbered = manifest.select(run, path, number.alias("step")).where(F.col("step").isNotNull())
    return numbered.groupBy(run).agg(F.max_by(path, "step").alias("latest_path"), F.max("step").alias("latest_step"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def run_key(dataset: Column, model: Column, checkpoint_dir: Column, thinking: Column, temperature: Column, val_n: Column) -> Column:
    """Report name; without a checkpoint its two parts are left out (null parts are skipped).

    Slashes at the end of a path don't count. A checkpoint folder without a parent leaves the run's part empty.
    """
    checkpoint_dir = F.regexp_replace(checkpoint_dir, "/+$", "")
    run = F.when(checkpoint_dir.isNotNull(), F.coalesce(F.try_element_at(F.split(checkpoint_dir, "/"), F.lit(-2)), F.lit("")))
    return F.concat_ws(
        "_",
        F.lit("eval_results"),
        dataset,
        base_name(F.regexp_replace(model, "/+$", "")),
        run,
        base_name(checkpoint_dir),
        F.when(thinking, "thinking").otherwise("nonthinking"),
        F.concat(F.lit("temp"), temperature.cast("string")),
        F.concat(F.lit("valn"), val_n.cast("string")),
    )
