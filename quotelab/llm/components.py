"""Connected components by smallest label, with pointer jumping; every step is joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelab.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of undirected ``edges`` (``a, b``: long).

    Each round takes the smallest label among a node's neighbours and then the label of that label, so
    that long chains shrink geometrically.  Labels are written after each round.
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = written(pairs, "pairs")
    labels = written(pairs.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = lower.join(jump, "via").select("node", F.least("via", "far").alias("component"), "old")
        new = written(new, "labels")
        labels = new.select("node", "component")
        if new.where("component < old").isEmpty():
            return labels
