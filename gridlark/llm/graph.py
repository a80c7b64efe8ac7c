"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import store


def star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are tied to the smallest of them and the node itself.

    Large stars move the larger neighbours of each node, small stars the
    smaller ones and the node. Minima are partial aggregates and the join back
    is split by Spark if a node is hot.
    """
    if large:
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    else:
        near = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    if large:
        moved = near.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        moved = near.join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b).

    Stops when no node has two parents and no parent has one, so the number of
    rounds grows with the logarithm of the longest path.
    """
    current = store(links.where("a <> b").select("a", "b").distinct(), label)
    while True:
        current = store(star(star(current, True), False), label)
        parents = current.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        done = parents.where("n > 1").isEmpty() and current.join(current.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        if done:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
