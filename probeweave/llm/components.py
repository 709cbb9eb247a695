"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeweave.llm.common import Steps


def connected_components(links: DataFrame, steps: Steps) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); the component is its smallest node.

    Each round takes the smallest label among a node's neighbours, then the label of that label. The pre-aggregated
    minimum carries one row per node and task, so a hub with a third of all links is no hot group, and the join that
    fetches labels has the hub on one side only. Rounds end when no label changes; each is written, so that a lost
    executor costs one round at most.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = steps.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.lit(True).alias("changed")))
    while labels.filter("changed").limit(1).count():
        sent = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("sent"))
        nearer = steps.write(labels.join(sent, "node").select("node", F.col("label").alias("before"), F.least("label", "sent").alias("label")))
        target = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = nearer.join(target, "label").select("node", F.least("label", "further").alias("label"), "before")
        last = steps.count
        labels = steps.write(jumped.select("node", "label", (F.col("label") != F.col("before")).alias("changed")))
        steps.drop(last)
    return labels.select("node", F.col("label").alias("component"))
