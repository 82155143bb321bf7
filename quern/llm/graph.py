"""Connected components as rounds of joins, for links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then jumps to the label's own label, so the
    number of rounds grows with the logarithm of a chain's length.  Rounds are written as tables.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        best = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        best = stored(best, "labels")
        up = best.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = stored(best.join(up, "component", "left").select("node", "old", F.coalesce("up", "component").alias("component")), "labels")
        if labels.where("component <> old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
