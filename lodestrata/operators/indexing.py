"""Global row numbers and order statistics without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_index(df: DataFrame, order: Sequence[Column | str], name: str = "point_idx", keep: Sequence[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with the 0-based position of each row in the given order, as a long.

    Rows are range-partitioned, sorted and numbered within their partition, by one shuffle; the sizes of earlier partitions, one number each,
    are added. Ties are numbered in an arbitrary order.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(parts.select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("__m")))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)  # partition, and row within it
    sizes = parts.groupBy(part.alias("__p")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = cut(sizes.select("__p", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first")))
    out = parts.join(F.broadcast(first), part == F.col("__p"))  # bounded by the number of partitions
    return out.withColumn(name, (F.col("__first") + place).cast("long")).drop("__p", "__m", "__first")


def order_statistics(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at 0-based rank ``floor((n - 1) * share)``, nulls left out; not interpolated.

    Equal values are one row with their count, so a value that many rows share fills no task. The driver gets one sum
    per partition, and only partitions that hold a wanted rank are read again.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    parts = cut(counted.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sizes = parts.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    total = sum(r["n"] for r in sizes)
    wanted, before = {}, 0
    for r in sizes:
        for name, share in shares.items():
            rank = int((total - 1) * share)
            if before <= rank < before + r["n"]:
                wanted[name] = r["p"], rank - before
        before += r["n"]
    running = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    held = parts.where(F.col("p").isin(sorted({p for p, _ in wanted.values()}))).withColumn("end", running)

    def at(name: str) -> Column:
        p, rank = wanted.get(name, (-1, -1))
        return F.max(F.when((F.col("p") == p) & (F.col("end") > rank) & (F.col("end") - F.col("n") <= rank), F.col("v"))).alias(name)

    return held.agg(*map(at, shares))
