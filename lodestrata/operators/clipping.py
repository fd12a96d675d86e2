"""Selections of points: slabs, boxes, spheres, polygons, planes, depth gaps; each a column or a filter without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .indexing import with_index


def slab(axis: Column, at: float, thickness: float) -> Column:
    return axis.between(at - thickness / 2, at + thickness / 2)


def box(x: Column, y: Column, z: Column, centre: Sequence[float], half: Sequence[float]) -> Column:
    out = F.lit(True)
    for c, m, h in zip((x, y, z), centre, half):
        out &= F.abs(c - m) <= h
    return out


def sphere(x: Column, y: Column, z: Column, centre: Sequence[float], radius: float) -> Column:
    return sum((((c - m) * (c - m)) for c, m in zip((x, y, z), centre)), F.lit(0.0)) <= radius * radius


def polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether (x, y) is inside a ring: an odd number of its edges cross the ray to the right."""
    corners = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring))
    following = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in [*ring[1:], ring[0]]))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    edges = F.zip_with(corners, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


#: Planes that are held by an expression at once.
PLANES = 64


def on_planes(points: DataFrame, planes: DataFrame, tolerance: float) -> DataFrame:
    """``points`` that no plane (a, b, c, d; unit normals) protects: none is nearer than the tolerance.

    Planes go out in blocks of ``PLANES``, as many as there are; each block is one row.
    """
    held = cut(planes.select("a", "b", "c", "d"))
    held = with_index(held, ["a", "b", "c", "d"], "no").withColumn("block", F.floor(F.col("no") / PLANES).cast("long"))
    blocks = cut(held.groupBy("block").agg(F.collect_list(F.struct("a", "b", "c", "d")).alias("planes")))

    def near(p: Column) -> Column:
        return F.abs(p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] * F.col("z") - p["d"]) <= tolerance

    for block in range(blocks.count()):
        one = F.broadcast(blocks.where(F.col("block") == block).select("planes"))
        points = points.crossJoin(one).where(~F.exists("planes", near)).drop("planes")
    return points


def front_of_gap(points: DataFrame, ray: Sequence[str], depth: str, spacing: float) -> DataFrame:
    """Points of each ray up to its first gap in depth: 8 spacings or 0.2, within the first band of 60 spacings or 1.2."""
    gap, band = max(8 * spacing, 0.2), max(60 * spacing, 1.2)
    order = Window.partitionBy(*ray).orderBy(depth)
    step = F.col(depth) - F.lag(depth).over(order)
    marked = points.withColumn("__far", (F.coalesce(step, F.lit(0.0)) > gap).cast("int"))
    marked = marked.withColumn("__gaps", F.sum("__far").over(order)).withColumn("__first", F.min(depth).over(Window.partitionBy(*ray)))
    return marked.where((F.col("__gaps") == 0) & (F.col(depth) - F.col("__first") <= band)).drop("__far", "__gaps", "__first")


def prune(points: DataFrame, centre: Sequence[Column], radius: Column, k: float = 2.5) -> DataFrame:
    """Points no further from the centre than ``k`` radii."""
    d2 = sum((((F.col(a) - c) * (F.col(a) - c)) for a, c in zip("xyz", centre)), F.lit(0.0))
    return points.where(d2 <= k * k * radius * radius)
