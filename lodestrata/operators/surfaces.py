"""Rasters and sections: contour segments of a height grid, sections of triangles by a plane, outlines of occupied cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def height_grid(points: DataFrame, cell: float, highest: bool = True) -> DataFrame:
    """(i, j, z): the highest or lowest point of each cell."""
    keys = [F.floor(F.col(a) / cell).cast("long").alias(k) for a, k in (("x", "i"), ("y", "j"))]
    return points.groupBy(*keys).agg((F.max if highest else F.min)("z").alias("z"))


def _corners(grid: DataFrame) -> DataFrame:
    """Cells whose four corners are there: heights z0 (i, j), z1 (i + 1, j), z2 (i + 1, j + 1), z3 (i, j + 1)."""
    moved = [("z0", 0, 0), ("z1", 1, 0), ("z2", 1, 1), ("z3", 0, 1)]
    dealt = grid.select(F.explode(F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(n).alias("n"), F.col("z").alias("z")) for n, a, b in moved))).alias("c")).select("c.*")
    found = dealt.groupBy("i", "j").agg(*(F.max(F.when(F.col("n") == n, F.col("z"))).alias(n) for n, _, _ in moved))
    return found.where(" and ".join(f"{n} is not null" for n, _, _ in moved))


def contours(grid: DataFrame, step: float, cell: float) -> DataFrame:
    """(i, j, level, x0, y0, x1, y1): segments of the level lines in each cell of four corners, by marching squares.

    The crossings of a cell's edges in turn are joined in pairs, so a saddle gives two segments. Each cell is
    assembled by one shuffle of its corners; there is no join.
    """
    cells = _corners(grid)
    low, high = F.least("z0", "z1", "z2", "z3"), F.greatest("z0", "z1", "z2", "z3")
    first, last = F.floor(low / step).cast("long") + 1, F.floor(high / step).cast("long")
    cells = cells.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("n"))
    cells = cells.withColumn("level", F.col("n") * F.lit(step))
    i, j, level = F.col("i"), F.col("j"), F.col("level")
    ends = [(i, j, "z0"), (i + 1, j, "z1"), (i + 1, j + 1, "z2"), (i, j + 1, "z3")]

    def crossing(a: tuple, b: tuple) -> Column:
        za, zb = F.col(a[2]), F.col(b[2])
        t = (level - za) / (zb - za)
        at = F.struct(((a[0] + (b[0] - a[0]) * t) * cell).alias("x"), ((a[1] + (b[1] - a[1]) * t) * cell).alias("y"))
        return F.when((za < level) != (zb < level), at)

    found = F.filter(F.array(*(crossing(a, b) for a, b in zip(ends, ends[1:] + ends[:1]))), lambda c: c.isNotNull())
    rows = cells.withColumn("p", found).where(F.size("p") >= 2)
    rows = rows.select("i", "j", "level", "p", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1)).alias("k"))
    a, b = F.get("p", F.col("k") * 2), F.get("p", F.col("k") * 2 + 1)
    return rows.select("i", "j", "level", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))


def mesh_section(triangles: DataFrame, at: float) -> DataFrame:
    """(id, x0, y0, x1, y1): the segment in which the plane z = ``at`` cuts each triangle (id; x, y, z of a, b, c)."""

    def crossing(p: str, q: str) -> Column:
        zp, zq = F.col(f"z{p}"), F.col(f"z{q}")
        t = (F.lit(at) - zp) / (zq - zp)
        point = F.struct(*((F.col(f"{c}{p}") + (F.col(f"{c}{q}") - F.col(f"{c}{p}")) * t).alias(c) for c in "xy"))
        return F.when((zp < at) != (zq < at), point)

    found = F.filter(F.array(crossing("a", "b"), crossing("b", "c"), crossing("c", "a")), lambda c: c.isNotNull())
    rows = triangles.withColumn("p", found).where(F.size("p") == 2)
    return rows.select("id", *(F.col("p")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in "xy"))


def outline(cells: DataFrame) -> DataFrame:
    """(i, j, side): the sides of occupied cells (i, j) that border on an empty one: the edges of the section's loops."""
    sides = [("left", -1, 0), ("right", 1, 0), ("below", 0, -1), ("above", 0, 1)]
    own = cells.select("i", "j").distinct()
    asked = own.select("i", "j", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("i") + a).alias("ni"), (F.col("j") + b).alias("nj")) for s, a, b in sides))).alias("s")).select("i", "j", "s.*")
    there = own.select(F.col("i").alias("ni"), F.col("j").alias("nj"))
    return asked.join(there, ["ni", "nj"], "left_anti").select("i", "j", "side")


#: Sides of a cell as directed edges with the cell to their left: below (east), right (north), above (west), left (south).
_SIDES = (("below", 0, -1, 0, 0, 1, 0), ("right", 1, 0, 1, 0, 1, 1), ("above", 0, 1, 1, 1, 0, 1), ("left", -1, 0, 0, 1, 0, 0))
#: Cells are numbered within this distance of the origin.
_REACH = 1 << 29


def half_edges(cells: DataFrame) -> DataFrame:
    """(id, next, x, y, turns): the open sides of occupied cells (i, j) as directed edges, each with the one that follows it.

    The occupied side is to the left. Where two cells touch at a corner only, an edge goes on along its own cell. ``x``, ``y`` is the
    edge's end, ``turns`` whether the next one has another direction. An id holds i, j and the side, in this order.
    """
    far = (F.abs("i") >= _REACH) | (F.abs("j") >= _REACH)
    own = cells.select("i", "j").distinct()
    own = own.withColumn("i", F.when(far, F.raise_error(F.lit("a cell is too far from the origin"))).otherwise(F.col("i")))
    sides = outline(own)
    number = F.element_at(F.create_map(*(F.lit(v) for k, s in enumerate(_SIDES) for v in (s[0], k))), F.col("side"))
    sides = sides.withColumn("d", number)

    def corner(at: int) -> Column:
        x = F.element_at(F.array(*(F.lit(s[at]) for s in _SIDES)), F.col("d") + 1)
        y = F.element_at(F.array(*(F.lit(s[at + 1]) for s in _SIDES)), F.col("d") + 1)
        return F.struct((F.col("i") + x).alias("x"), (F.col("j") + y).alias("y"))

    edge_id = F.shiftleft(F.col("i") + _REACH, 32) + (F.col("j") + _REACH) * 4 + F.col("d")
    edges = sides.select(edge_id.alias("id"), "d", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), corner(at).alias("v")) for n, at in (("out", 3), ("in", 5))))).alias("e"))
    edge = F.struct("id", "d")
    at = edges.groupBy("e.v").agg(*(F.collect_list(F.when(F.col("e.n") == n, edge)).alias(n) for n in ("in", "out")))  # two of each at most
    # Of the edges that leave the corner the one that turns left most follows.
    arrived = at.select("v", "out", F.explode("in").alias("a"))
    after = F.element_at(F.array_sort(F.transform("out", lambda o: F.struct(F.pmod(F.col("a.d") - o["d"] + 1, F.lit(4)).alias("turn"), o["id"].alias("id"), o["d"].alias("d")))), 1)
    return arrived.withColumn("o", after).select("a.id", F.col("o.id").alias("next"), "v.x", "v.y", (F.col("o.d") != F.col("a.d")).alias("turns"))


def cycles(links: DataFrame) -> DataFrame:
    """(id, loop, place, length) for links (id, next) that form cycles: the smallest id of the cycle, and steps from it.

    Pointer doubling: after k rounds each row knows the smallest id among the 2^k rows from it on, where it comes first and,
    once it comes twice, the length of the cycle. A cycle is done when 2^k is twice its length and drops out; the number of
    rounds is the logarithm of the longest. One join a round; nothing reaches the driver but whether rows are left.
    """
    width = 1
    rows = cut(links.select("id", "next", F.col("id").alias("least"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("length")))
    done = []
    while True:
        ahead = rows.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("least").alias("l2"), F.col("first").alias("f2"), F.col("length").alias("n2"))
        both = rows.join(ahead, "next")
        there = F.col("f2") + width
        first = F.when(F.col("least") <= F.col("l2"), F.col("first")).otherwise(there)
        length = F.when(F.col("least") < F.col("l2"), F.col("length")).when(F.col("least") > F.col("l2"), F.col("n2")).otherwise(F.coalesce("length", there - F.col("first")))
        rows = cut(both.select("id", F.col("next2").alias("next"), F.least("least", "l2").alias("least"), first.alias("first"), length.alias("length")))
        width *= 2
        settled = F.coalesce(F.col("length") * 2 <= width, F.lit(False))
        done.append(rows.where(settled))
        rows = rows.where(~settled)
        if rows.isEmpty():
            break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select("id", F.col("least").alias("loop"), F.pmod(F.col("length") - F.col("first"), F.col("length")).alias("place"), "length")


def loops(cells: DataFrame) -> DataFrame:
    """(loop, place, x, y, area, outer): the corners of the closed outlines of occupied cells, in order.

    ``place`` counts sides from the loop's smallest edge. Outer rings run counter-clockwise and have a positive area; holes
    run clockwise and have a negative one, in cells.
    """
    edges = cut(half_edges(cells))
    placed = edges.join(cycles(edges), "id")
    # The shoelace sum of upright edges: up adds x, down takes it away.
    d = F.pmod(F.col("id"), F.lit(4))
    areas = placed.groupBy("loop").agg(F.sum(F.when(d == 1, F.col("x")).when(d == 3, -F.col("x")).otherwise(0)).cast("long").alias("area"))
    return placed.where("turns").join(areas, "loop").select("loop", "place", "x", "y", "area", (F.col("area") > 0).alias("outer"))


def fill_inward(known: DataFrame, holes: DataFrame, colours: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(i, j, ring, colours): the cells of ``holes`` that known cells can reach, coloured ring by ring from the edge inward.

    ``known`` has i, j and whole colours, ``holes`` i, j; a cell in both is known. A cell's colour is the mean, rounded
    half up, of its neighbours in the ring before, of eight at most. Neighbours are at most a ring apart, so a round joins the
    last ring with the holes and leaves out the cells of the last two; its work is that of the ring, and rounds are as
    many as the hole is deep.
    """
    keys = ["i", "j"]
    known = known.select(*keys, *colours)
    open_ = cut(holes.select(*keys).distinct().join(known.select(*keys), keys, "left_anti"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    last = known.withColumn("ring", F.lit(0))
    before, rings = None, []
    while True:
        sent = last.select("ring", *colours, F.explode(steps).alias("s"), *keys)
        sent = sent.select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "ring", *colours)
        got = sent.groupBy(*keys, "ring").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in colours))
        got = got.join(open_, keys, "left_semi")
        if rings:
            got = got.join(last.select(*keys), keys, "left_anti")
        if before is not None:
            got = got.join(before.select(*keys), keys, "left_anti")
        # floor((2 sum + n) / 2 n): half up without a fraction
        mean = [F.floor((F.col(c) * 2 + F.col("n")) / (F.col("n") * 2)).cast("long").alias(c) for c in colours]
        before, last = (last if rings else None), cut(got.select(*keys, (F.col("ring") + 1).alias("ring"), *mean))
        if last.isEmpty():
            break
        rings.append(last)
    out = last
    for ring in rings:
        out = out.unionByName(ring)
    return out
