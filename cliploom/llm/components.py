"""Connected components of an undirected graph, as joins and aggregations until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b).

    A round gives each node the smallest label among its neighbours, then the label of its label, so chains shorten by
    half a round. Minima are pre-aggregated before the shuffle, and labels are checkpointed between rounds."""
    both = checkpointed(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "near"}), "near").groupBy("node").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        # A label is a node of the same component, so it has a label itself.
        after = checkpointed(lower.join(jump, "component").select("node", "before", F.least("component", "further").alias("component")))
        changed = after.filter(F.col("component") != F.col("before")).limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
