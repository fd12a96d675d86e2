"""An octree as a table: nodes are partitions, so a node is read by pruning and a level by its prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 120_000
LEAST_CAPACITY = 1000


def key(x: Column, y: Column, z: Column, low: list[float], size: float, depth: int) -> Column:
    """Path of octants from the root, one digit 0..7 a level: r, r0, r07, ..."""
    steps = []
    for level in range(1, depth + 1):
        side = size / (1 << level)
        bit = [F.pmod(F.floor((c - o) / side), F.lit(2)) for c, o in zip((x, y, z), low)]
        steps.append((bit[0] + 2 * bit[1] + 4 * bit[2]).cast("int").cast("string"))
    return F.concat(F.lit("r"), *steps)


def nodes(points: DataFrame, capacity: int = CAPACITY, depth: int = 10) -> DataFrame:
    """``points`` (x, y, z) with the node of each: the highest that holds at most ``capacity`` points, or the deepest.

    Counts per deepest key are summed to every level above, so points are scanned twice and shuffled once, as counts.
    """
    capacity = max(LEAST_CAPACITY, capacity)
    box = points.agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if box is None or box.lox is None:
        return points.withColumn("node", F.lit("r"))
    low = [box.lox, box.loy, box.loz]
    size = max(max(box.hix - box.lox, box.hiy - box.loy, box.hiz - box.loz) * (1 + 1e-9), 1e-9)
    keyed = points.withColumn("__key", key(F.col("x"), F.col("y"), F.col("z"), low, size, depth))
    deep = keyed.groupBy("__key").agg(F.count("*").alias("n"))
    levels = deep.select("__key", "n", F.explode(F.sequence(F.lit(1), F.lit(depth + 1))).alias("length"))
    sums = levels.groupBy(F.substring("__key", F.lit(1), F.col("length")).alias("node")).agg(F.sum("n").alias("n"))
    fitting = cut(sums.where((F.col("n") <= capacity) | (F.length("node") == depth + 1)))
    # The shortest fitting prefix of each deepest key.
    own = deep.select("__key", F.explode(F.sequence(F.lit(1), F.lit(depth + 1))).alias("length")).withColumn("node", F.substring("__key", F.lit(1), F.col("length")))
    best = own.join(fitting, "node").groupBy("__key").agg(F.min_by("node", "length").alias("node"))
    return keyed.join(best, "__key").drop("__key")


def build(points: DataFrame, path: str, capacity: int = CAPACITY, depth: int = 10) -> None:
    """Write the nodes as a partitioned table."""
    nodes(points, capacity, depth).repartition("node").write.partitionBy("node").mode("overwrite").parquet(path)


def read_node(spark: SparkSession, path: str, node: str) -> DataFrame:
    """One node's points; other partitions are not opened."""
    return spark.read.option("basePath", path).parquet(path).where(F.col("node") == node)
