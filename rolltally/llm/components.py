"""Connected components of a table of links, by smallest reachable label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolltally.llm.store import store


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (longs) -> ``id, label`` for every id that stands in a link: the smallest id reachable.

    Each round every id takes the smallest label of itself and its neighbours, then the label of that label (so paths halve).
    Rounds are written to the shared folder; sums are combined before each exchange, so an id with very many links is no hot task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    both = store(both, "links")
    labels = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = stepped.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = stepped.join(jump, stepped.label == jump.via).select("id", "was", F.least("label", "far").alias("label"))
        new = store(new, "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
