"""Connected components of a graph of links, by joins and grouping alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, saved


def components(links: DataFrame) -> DataFrame:
    """(node, component, moved) for every node of links (a, b), as a saved table: the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours and then that label's own
    label, so paths halve; the table of labels is cut off its lineage after each round.
    An empty table of links gives an empty result.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        closer = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("closer"))
        far = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        step = saved(
            closer.join(far, F.col("closer") == F.col("via"))
            .select("node", F.least("closer", "far").alias("component"), (F.least("closer", "far") != F.col("component")).alias("moved"))
        )
        done = step.where("moved").isEmpty()
        discarded(labels)
        if done:
            discarded(both)
            return step
        labels = step
