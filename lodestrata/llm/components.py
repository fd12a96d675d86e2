"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every end of the links (a, b): the smallest node that it is connected with.

    Large-star and small-star rounds: links are turned towards smaller nodes until each component is a star around its
    smallest node, in a number of rounds that grows with the logarithm of the longest path. Each round is written
    to the shared folder, only counts reach the driver, and joins are on keys that Spark may split.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = cut(pairs.distinct())
    before = None
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour or to itself.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
