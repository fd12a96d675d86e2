"""Neighbour operators on a voxel grid: equi-joins over neighbouring cells, never all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

AXES = ("x", "y", "z")


def cell(size: float, axes: tuple[str, ...] = AXES) -> list[Column]:
    """Integer grid coordinates c0, c1, ... of a point."""
    return [F.floor(F.col(a) / size).cast("long").alias(f"c{i}") for i, a in enumerate(axes)]


def around(reach: int = 1, dims: int = 3) -> Column:
    """The (2 reach + 1) ** dims offsets of neighbouring cells, as an array of structs."""
    steps = range(-reach, reach + 1)
    offsets = [[]]
    for _ in range(dims):
        offsets = [[*o, s] for o in offsets for s in steps]
    return F.array(*(F.struct(*(F.lit(s).cast("long").alias(f"o{i}") for i, s in enumerate(o))) for o in offsets))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keep_self: bool = True) -> DataFrame:
    """(id, other, d2) of all pairs within the radius; both sides have id, x, y, z.

    The cell is as wide as the radius, so the 27 cells around a point hold all its neighbours; only occupied cells meet.
    """
    a = left.select(F.col("id"), *AXES, *cell(radius))
    a = a.withColumn("o", F.explode(around())).select("id", *AXES, *((F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(3)))
    b = right.select(F.col("id").alias("other"), *(F.col(k).alias(f"b{k}") for k in AXES), *cell(radius))
    d2 = sum(((F.col(k) - F.col(f"b{k}")) * (F.col(k) - F.col(f"b{k}")) for k in AXES[1:]), (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")))
    pairs = a.join(b, ["c0", "c1", "c2"]).select("id", "other", d2.alias("d2")).where(F.col("d2") <= radius * radius)
    return pairs if keep_self else pairs.where("id <> other")


#: Finest grid of a search: the first cell halved so often, beyond what the number of points asks for, and at most.
FINER, FINEST = 3, 20


def _at_level(radius: float, level: Column) -> list[Column]:
    """Grid coordinates in cells of ``radius`` halved ``level`` times (doubled, if negative); each level's cells nest in the last's."""
    return [F.floor(F.col(a) / radius * F.pow(F.lit(2.0), level)).cast("long").alias(f"c{i}") for i, a in enumerate(AXES)]


def nearest(asked: DataFrame, points: DataFrame, k: int, radius: float, widen: bool, own: bool, rounds: int = 12) -> DataFrame:
    """(id, other, rank, d2): for each asked point its k nearest of ``points``, exactly; ties go to the smaller id.

    The cells of a search are as wide as the points are dense: each point begins in the smallest cell, at most ``radius`` wide,
    that holds over half of k, and what lies within a cell's width is in the 27 around it. Points with fewer than k within that width
    go on in cells twice as wide; so the pairs grow with the points, not with the square of their density. Of points in one place
    only the first ids can be among the k nearest. Cells end at ``radius``, or, with ``widen``, where all k are
    found; without ``own`` a point's own id is not counted.
    """
    here = F.lit(True)
    for a in AXES:
        here &= F.abs(a) < float("inf")  # neither null nor not a number
    keep = k if own else k + 1
    place = Window.partitionBy(*AXES).orderBy("id")
    there = points.where(here).select("id", *(F.col(a) + 0.0 for a in AXES)).toDF("id", *AXES)
    there = cut(there.withColumn("r", F.row_number().over(place)).where(F.col("r") <= keep).drop("r"))
    total = points.where(here).limit(k + 1).count()
    want = min(k, total if own else max(total - 1, 0))
    asked = asked.where(here).select("id", *AXES)
    if want == 0:
        return asked.limit(0).select("id", F.col("id").alias("other"), F.lit(0).alias("rank"), F.lit(0.0).alias("d2"))
    deepest = min(FINEST, math.ceil(math.log(max(there.count(), 2), 8)) + FINER)
    levels = F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("level")
    keys = ["level", "c0", "c1", "c2"]

    def celled(df: DataFrame, *more: str) -> DataFrame:
        return df.select("id", *AXES, levels).select(*more, "level", *_at_level(radius, F.col("level")))

    full = celled(there).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= k // 2 + 1).select(*keys)
    start = celled(asked, "id").join(full.hint("merge"), keys).groupBy("id").agg(F.max("level").alias("level"))
    open_ = cut(asked.join(start, "id", "left").fillna(0, ["level"]))
    rank = Window.partitionBy("id").orderBy("d2", "other")
    b = there.select(F.col("id").alias("other"), *(F.col(x).alias(f"b{x}") for x in AXES), *AXES)
    done = None
    for _ in range(FINEST + rounds):
        used = [r["level"] for r in open_.select("level").distinct().collect()]  # one number a level
        if not used:
            break
        a = open_.withColumn("o", F.explode(around())).select("id", *AXES, "level", *((c + F.col(f"o.o{i}")).alias(f"c{i}") for i, c in enumerate(_at_level(radius, F.col("level")))))
        right = b.withColumn("level", F.explode(F.array(*map(F.lit, used)))).select("other", "bx", "by", "bz", "level", *_at_level(radius, F.col("level")))
        d2 = sum(((F.col(x) - F.col(f"b{x}")) * (F.col(x) - F.col(f"b{x}")) for x in AXES[1:]), (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")))
        width = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
        pairs = a.join(right.hint("merge"), keys).select("id", "other", d2.alias("d2"), width.alias("w")).where(F.col("d2") <= F.col("w") * F.col("w"))
        pairs = pairs if own else pairs.where("id <> other")
        near = cut(pairs.select("id", "other", "d2").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k))
        counts = near.groupBy("id").agg(F.count("*").alias("n"))
        rest = open_.join(counts, "id", "left").where(F.coalesce("n", F.lit(0)) < want).drop("n")
        if not widen:
            rest = rest.where(F.col("level") > 0)
        rest = cut(rest.select("id", *AXES, (F.col("level") - 1).alias("level")))
        found = near.join(rest.select("id"), "id", "left_anti")
        done = found if done is None else done.unionByName(found)
        open_ = rest
    if done is None:
        return asked.limit(0).select("id", F.col("id").alias("other"), F.lit(0).alias("rank"), F.lit(0.0).alias("d2"))
    if not open_.isEmpty():
        raise ValueError("points are spread too far for the first radius")
    return done.select("id", "other", "rank", "d2")


def k_nearest(points: DataFrame, k: int, radius: float, rounds: int = 12) -> DataFrame:
    """(id, other, rank, d2): the k nearest other points of each, exactly; ties go to the smaller id.

    The grid is finer than ``radius`` where points are dense and grows coarser for points that lack neighbours, until it
    holds all points.
    """
    return nearest(points, points, k, radius, widen=True, own=False, rounds=rounds)


def components(cells: DataFrame, keys: list[str], rounds: int = 200) -> DataFrame:
    """Occupied cells with the smallest cell number of their 26-connected component: keys, label.

    Minimum labels spread over the neighbour relation with pointer jumping; each round is cut from its lineage.
    """
    nodes = cells.select(*keys).distinct()
    name = F.concat_ws(":", *(F.lpad((F.col(k) + 1_000_000_000).cast("string"), 10, "0") for k in keys))
    nodes = cut(nodes.withColumn("node", name))
    moved = nodes.withColumn("o", F.explode(around(dims=len(keys)))).select(F.col("node").alias("a"), *((F.col(k) + F.col(f"o.o{i}")).alias(k) for i, k in enumerate(keys)))
    edges = cut(moved.join(nodes, keys).select("a", F.col("node").alias("b")).where("a <> b"))
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        best = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        nxt = labels.join(best, labels.node == best.a, "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
        up = nxt.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        nxt = cut(nxt.join(up, nxt.label == up.n2, "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label")))
        if nxt.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            break
        labels = nxt
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(labels, "node").select(*keys, "label")
