"""Headline queries timed on local[BENCH_CPUS]; prints one JSON line.

Derived tables are staged first (``prepare`` holds these times, from the raw tables to the narrow inputs). Each query
then runs twice into a no-op sink: ``cold`` holds the first run, ``queries`` the second, and ``total`` everything of a first pass, staging included.
``calibration`` is a fixed job of Spark's own (no code of this package), so that runs on machines of different speed can be compared.
"""

from __future__ import annotations

import json
import os
import time

from rolltally.plans import catalog
from rolltally.plans.flagship import vote_report
from rolltally.plans.session import local_session
from rolltally.sources import views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "extract_boxed_first", "extract_boxed_last", "answer_key", "repair_queue", "merge_repairs", "majority_vote",
    "majority_vote_raw", "join_vote_back", "answer_equijoin", "reward_majority", "eval_per_problem", "eval_summary",
    "vote_metrics", "signal_accuracy", "select_shortest", "select_sqrt", "direction_sign", "teacher_privilege", "grpo_advantage",
    "running_metrics", "ema_series", "snapshot_asof", "metric_window_mean", "dedup_rollouts", "group_duplicate_prompts",
    "forward_kl", "generalized_jsd", "topk_renorm_jsd", "soft_or_weight", "topk_tokens", "hybrid_loss", "pad_truncate",
    "build_training_set", "leaderboard", "stream_metric_window", "stream_vote",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    fixed = spark.range(1 << 25).selectExpr("id % 4096 AS k", "sha2(cast(id AS string), 256) AS x").groupBy("k").agg({"x": "max"})
    drain(fixed)
    calibration = seconds(lambda: drain(fixed))
    prepare = {
        "rollouts": seconds(lambda: views.rollouts(spark, SF_DIR)),
        "answers": seconds(lambda: views.answers(spark, SF_DIR)),
        "votes": seconds(lambda: catalog.votes(spark, SF_DIR)),
        "clusters": seconds(lambda: catalog.clusters(spark, SF_DIR)),
        "chosen": seconds(lambda: catalog.chosen(spark, SF_DIR)),
        "graded": seconds(lambda: views.graded(spark, SF_DIR)),
        "masked_tokens": seconds(lambda: views.masked(spark, SF_DIR)),
        "steps": seconds(lambda: views.steps(spark, SF_DIR)),
    }
    queries = {"vote_report": lambda: drain(vote_report(spark, SF_DIR))}
    for name in HEADLINE:
        queries[name] = lambda q=catalog.QUERIES[name]: drain(q(spark, SF_DIR))
    cold, times = {}, {}
    for name, run in queries.items():
        cold[name], times[name] = seconds(run), seconds(run)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "calibration": calibration,
                "prepare": prepare,
                "cold": cold,
                "total": round(sum(prepare.values()) + sum(cold.values()), 3),
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
