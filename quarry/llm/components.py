"""Connected components of a graph given as links, by joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b", node: str = "node", label: str = "label") -> DataFrame:
    """node, label of each node that links name: label is the smallest node reachable. No links: no rows.

    Alternates two steps until nothing changes: every node takes the smallest label among itself and its neighbours, and
    labels are followed one step further (pointer jumping), so chains shorten by halves. Neighbours' labels are minima that
    are combined before the shuffle, so a node with very many links is no single task.
    """
    edges = stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct())
    state = stored(edges.groupBy(F.col("x").alias("n")).agg(F.min("y").alias("m")).select("n", F.least("n", "m").alias("l")))
    while True:
        near = edges.join(state.select(F.col("n").alias("y"), "l"), "y").groupBy(F.col("x").alias("n")).agg(F.min("l").alias("m"))
        step = stored(state.join(near, "n").select("n", F.col("l").alias("old"), F.least("l", "m").alias("l")))
        jumped = step.join(step.select(F.col("n").alias("l"), F.col("l").alias("far")), "l", "left").select("n", "old", F.least("l", F.coalesce("far", "l")).alias("l"))
        after = stored(jumped)
        if after.where("old <> l").isEmpty():
            return after.select(F.col("n").alias(node), F.col("l").alias(label))
        state = after.select("n", "l")
