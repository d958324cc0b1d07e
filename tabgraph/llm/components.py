"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); the component is its smallest id.

    Each round every node takes the smallest label among its neighbours, then the label of its
    label. Labels halve the remaining distance, so rounds grow with the logarithm of the
    longest chain. Neighbour minima combine before the shuffle, so a hub is one row per task.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(seen, labels.id == seen.a).select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("hop"))
        jump = labels.select(F.col("id").alias("hop"), F.col("component").alias("far"))
        new = materialize(near.join(jump, "hop").select("id", "old", F.least("hop", "far").alias("component")))
        if new.filter("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
