"""Structured Streaming jobs.

A job takes a streaming DataFrame and returns one, which ``drain`` runs to a table; state is keyed and bounded by event time:

* ``metric_windows`` closes tumbling windows behind a watermark. Rows whose event time lies further behind their arrival than the
  delay go to a side table (``late_rows``), by their own two times, so that it does not matter how the input is cut into files.
* ``vote_on_arrival`` emits a prompt's vote once its rollouts have arrived or its time is up, and then forgets it.
* ``drain_votes`` does so for a stream that is drained, without waiting: what is open lies in a table between micro-batches.
* ``dedup`` drops repeats within a delay.

What is still open when a run ends is in its state store, and ``open_windows`` reads it from there. For prompts without a known number of rollouts
there are partial aggregates per micro-batch (``drain_partials``) and a merge of all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial as bound
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from rolltally.functions.answers import strip
from rolltally.operators.vote import with_answers, with_repairs
from rolltally.sources.sinks import flush_step
from rolltally.sources.staging import new_path


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def drain(stream: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Process what is available into a checkpointed file sink and read the result back."""
    return drained(stream, name, partition_by)[0]


def drained(stream: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """The same, and the path of the checkpoint, where the state lies."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    if partition_by:  # rows of a folder come together, or every task would write a file into every folder
        stream = stream.hint("rebalance", *partition_by)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("checkpointLocation", f"{path}-progress").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), f"{path}-progress"


def drain_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Process what is available and return the partial aggregates of all micro-batches."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    empty = partial(spark.createDataFrame([], stream.schema))
    empty.write.parquet(f"{path}/batch=-1")  # so that an empty source has a table, too

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(sink).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}-progress").start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(path).select(*empty.columns)


def is_late(delay: str, ts: str = "ts", arrived: str = "arrived") -> Column:
    """Whether a row arrived more than ``delay`` after its event time. Rows that arrive in order and are not late are never behind a watermark of that delay."""
    return F.coalesce(F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {delay}") < F.col(arrived).cast("timestamp"), F.lit(False))


def late_rows(log: DataFrame, delay: str, ts: str = "ts", arrived: str = "arrived") -> DataFrame:
    """The rows that no window takes any more, for a table of their own."""
    return log.where(is_late(delay, ts, arrived))


def metric_windows(log: DataFrame, window: str, delay: str, ts: str = "ts", arrived: str = "arrived") -> DataFrame:
    """``window, name, sum_value, n_value, n_values`` of each tumbling window, once it is ``delay`` behind the latest event. Rows without an event time are in no window."""
    on_time = log.where(~is_late(delay, ts, arrived)).withColumn(ts, F.col(ts).cast("timestamp"))
    return on_time.withWatermark(ts, delay).groupBy(F.window(ts, window), "name").agg(*_sums())


def _sums() -> list[Column]:
    return [F.sum("value").alias("sum_value"), F.count("value").alias("n_value"), F.count(F.lit(1)).alias("n_values")]


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows of ``metric_windows`` that had not been closed when the run ended, as they stand in its state store."""
    state = spark.read.format("statestore").load(checkpoint)
    held = state.schema["value"].dataType  # sum and counts, in the order of the aggregates
    named = StructType([StructField(n, f.dataType) for n, f in zip(("sum_value", "n_value", "n_values"), held.fields, strict=True)])
    return state.select("key.window", "key.name", F.col("value").cast(named).alias("value")).select("window", "name", "value.*")


def window_means(windows: DataFrame) -> DataFrame:
    """Mean of each metric per window."""
    mean = F.when(F.col("n_value") > 0, F.col("sum_value") / F.col("n_value"))
    return windows.select("window", "name", mean.alias("mean_value"), "n_values")


def _combined(batches: Iterator[pa.RecordBatch], order: list[str], rest: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with the same prompt and answer become one, with the first answer and the latest time."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in order])
        groups = rows.group_by(["prompt_id", "answer_key"], use_threads=False)
        firsts = [(c, "first", pa.compute.ScalarAggregateOptions(skip_nulls=False)) for c in [*order, "answer"]]
        out = groups.aggregate([("n", "sum"), *firsts, *[(c, "max") for c in rest]])
        columns = ["prompt_id", "answer_key", "n_sum", *[f"{c}_first" for c in [*order, "answer"]], *[f"{c}_max" for c in rest]]
        yield from out.select(columns).rename_columns(["prompt_id", "answer_key", "n", *order, "answer", *rest]).to_batches()


class _Clusters:
    """Sizes and first members of a prompt's answers."""

    def __init__(self, said: str | None = None) -> None:
        self.found: dict[str | None, list] = {}
        for key, n, first, answer in json.loads(said) if said else []:
            self.found[key] = [n, first, answer]

    def add(self, key: str | None, n: int, first: list, answer: str | None) -> None:
        have = self.found.get(key)
        if have is None:
            self.found[key] = [n, first, answer]
        else:
            have[0] += n
            if _order(first) < _order(have[1]):
                have[1:] = first, answer

    @property
    def rollouts(self) -> int:
        return sum(n for n, _, _ in self.found.values())

    def said(self) -> str:
        return json.dumps([[key, *rest] for key, rest in self.found.items()])

    def vote(self) -> tuple[str | None, int]:
        """Label and size of the biggest cluster; ties go to the shorter, then to the earlier answer."""
        best = min(((-n, len((answer or "").strip()), _order(first), answer) for key, (n, first, answer) in self.found.items() if key is not None), default=None)
        return (best[3], -best[0]) if best else (None, 0)


def _order(first: list) -> tuple:
    return tuple((x is not None, x) for x in first)  # nulls come first, as in Spark


def _plain(x: Any) -> Any:
    return None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x


_VOTE = "prompt_id long, pseudo_label string, consensus_count long, n_rollouts long, complete boolean"


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, order: list[str], wait_ms: int | None) -> Iterator[pd.DataFrame]:
    said, expected, closed = state.get if state.exists else (None, None, False)
    clusters = _Clusters(said)
    latest = 0
    if not state.hasTimedOut:
        for rows in batches:
            if closed:
                continue
            for row in rows.itertuples(index=False):
                clusters.add(_plain(row.answer_key), int(row.n), [_plain(getattr(row, c)) for c in order], _plain(row.answer))
                expected = max(expected or 0, int(row.expected))
                if wait_ms is not None:
                    latest = max(latest, int(row.ts.timestamp() * 1000))
        if closed:
            return
    complete = clusters.rollouts >= (expected or 0)
    if state.hasTimedOut and closed:
        state.remove()
        return
    if complete or state.hasTimedOut:
        label, votes = clusters.vote()
        yield pd.DataFrame({"prompt_id": [key[0]], "pseudo_label": [label], "consensus_count": [votes], "n_rollouts": [clusters.rollouts], "complete": [complete]})
        if wait_ms is None:
            if state.exists:
                state.remove()
            return
        state.update((None, None, True))  # what still comes within the wait is too late
    else:
        state.update((clusters.said(), expected, False))
    if wait_ms is not None:
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait_ms)


def vote_on_arrival(rollouts: DataFrame, order: list[str], wait: str | None = None, ts: str = "ts") -> DataFrame:
    """One vote per prompt, emitted when ``expected`` rollouts (a column) have arrived, or, with ``wait``, when none came for so long in event time.

    ``rollouts``: ``prompt_id, answer, answer_key, expected`` and the ``order`` columns (numbers or texts), keyed by nothing else; repeats are dropped before, by ``dedup``.
    The state holds one entry per distinct answer of an open prompt. It is removed with the vote; with ``wait`` a mark stays as long, so that
    stragglers don't open the prompt again. Rows of a prompt are combined per answer before they are exchanged.
    """
    narrow = [F.col("prompt_id").cast("long").alias("prompt_id"), "answer_key", F.lit(1).cast("long").alias("n"), *order, "answer", F.col("expected").cast("long").alias("expected")]
    rest = ["expected"]
    if wait is not None:
        narrow.append(F.col(ts).cast("timestamp").alias("ts"))
        rest.append("ts")
    rows = rollouts.select(*narrow)
    rows = rows.mapInArrow(bound(_combined, order=order, rest=rest), rows.schema)
    if wait is not None:
        rows = rows.withWatermark("ts", wait)
    wait_ms = None if wait is None else int(pd.Timedelta(wait).total_seconds() * 1000)
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.EventTimeTimeout
    decide = bound(_decide, order=order, wait_ms=wait_ms)
    return rows.groupBy("prompt_id").applyInPandasWithState(decide, _VOTE, "said string, expected long, closed boolean", "append", timeout)


def vote_partials(rollouts: DataFrame, order: list[str]) -> DataFrame:
    """Size and first answer of each (prompt, answer) cluster, for a micro-batch or a whole table."""
    return rollouts.groupBy("prompt_id", "answer_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order, "answer")).alias("_first")
    )


def vote(partials: DataFrame) -> DataFrame:
    """Majority vote per prompt over all rollouts that have arrived.

    Clusters of all micro-batches are merged, then the clusters of a prompt compete. No list of rollouts is ever kept, so a prompt may
    have any number of them.
    """
    clusters = partials.groupBy("prompt_id", "answer_key").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    rank = F.when(
        F.col("answer_key").isNotNull(),
        F.struct(
            (-F.col("_n")).alias("n"), F.length(strip(F.col("_first.answer"))).alias("size"), F.col("_first").alias("first")
        ),
    )
    return (
        clusters.groupBy("prompt_id")
        .agg(F.min(rank).alias("_best"), F.sum("_n").alias("n_rollouts"))
        .select(
            "prompt_id",
            F.col("_best.first.answer").alias("pseudo_label"),
            F.coalesce(-F.col("_best.n"), F.lit(0)).alias("consensus_count"),
            "n_rollouts",
        )
    )


def drain_votes(rollouts: DataFrame, order: list[str], expected: DataFrame, name: str) -> DataFrame:
    """One vote per prompt, made with the micro-batch in which its ``expected`` rollouts have arrived.

    ``expected``: ``prompt_id, expected``; prompts without a row there get no vote. A batch is reduced to its clusters, merged with those of the prompts
    that were open, and cut into votes and what stays open. Everything is an aggregate or a join over tables keyed by batch, so a batch that runs again
    replaces its own and a prompt may have any number of rollouts.
    """
    spark = rollouts.sparkSession
    path = new_path(spark, name)
    empty = vote_partials(spark.createDataFrame([], rollouts.schema), order)
    empty.write.parquet(f"{path}/open/batch=-1")
    vote(empty).write.parquet(f"{path}/votes/batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        read = lambda kind, n: batch.sparkSession.read.schema(empty.schema).parquet(f"{path}/{kind}/batch={n}")
        both = vote_partials(batch, order).unionByName(read("open", batch_id - 1))
        merged = both.groupBy("prompt_id", "answer_key").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
        merged.write.mode("overwrite").parquet(f"{path}/clusters/batch={batch_id}")
        merged = read("clusters", batch_id)
        arrived = merged.groupBy("prompt_id").agg(F.sum("_n").alias("_arrived")).join(expected, "prompt_id")
        complete = F.col("_arrived") >= F.col("expected")
        for kind, side, made in (("votes", complete, vote), ("open", ~complete, lambda rows: rows)):
            rows = merged.join(arrived.where(side), "prompt_id", "left_semi")
            made(rows).write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch_id}")

    writer = rollouts.writeStream.foreachBatch(sink).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}-progress").start().awaitTermination()
    votes = vote(empty)
    return spark.read.schema(votes.schema).parquet(f"{path}/votes").select(*votes.columns)


def dedup(rollouts: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Drop repeats of a key that arrive within ``delay``; older state is forgotten."""
    return rollouts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rollout_log(rollouts: DataFrame, step, every: int = 5) -> DataFrame:
    """Log rows with their answer (repaired where there is a ``continuation``) and flush step, for an append sink partitioned by ``flush_step``."""
    texts = rollouts.withColumn("text", F.col("completion"))
    rows = with_answers(texts, "text")
    if "continuation" in rows.columns:
        rows = with_repairs(rows)
    rows = rows.withColumn("step", step.cast("bigint"))
    return rows.withColumn("flush_step", flush_step(F.col("step"), every)).select(
        "flush_step", "step", "prompt_id", "rollout_idx", "completion", F.coalesce("answer", F.lit("")).alias("answer")
    )
