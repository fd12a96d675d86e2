"""Walls from the fitted lines of their faces: which two faces bound one wall, its axis and its thickness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("x0", "y0", "x1", "y1")
#: The width of a cell in units of the distance that is sought; 2 at least. Wider cells are fewer a face and hold more faces.
WIDTH = 6.0


def _length() -> Column:
    return F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def _cells(step: float, size: float, reach: float) -> Column:
    """The cells, each a number, that hold a point of a face or come within ``reach`` (half a cell at most) of one.

    A face shorter than a cell has those of the corners of its box, grown by ``reach``; along others points are ``step`` apart at most,
    the face's ends among them. Cells that share a number only meet more than they need to.
    """

    def held(lo: tuple[Column, ...], hi: tuple[Column, ...]) -> Column:
        i, j = ([F.floor((p + by) / size) for p, by in ((a, -reach), (b, reach))] for a, b in zip(lo, hi))
        return F.array(*(F.shiftleft(c, 32).bitwiseXOR(d.bitwiseAND(0xFFFFFFFF)) for c in i for d in j))

    def passed(k: Column) -> Column:
        t = F.least(k * step / F.col("length"), F.lit(1.0))
        p = tuple(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * t for a in "xy")
        return held(p, p)

    lo, hi = (tuple(f(f"{a}0", f"{a}1") for a in "xy") for f in (F.least, F.greatest))
    short = F.greatest(*(b - a for a, b in zip(lo, hi))) <= 0.99 * (size - 2 * reach)
    points = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / step).cast("long"))
    return F.array_distinct(F.when(short, held(lo, hi)).otherwise(F.flatten(F.transform(points, passed))))


def facing(faces: DataFrame, thinnest: float, thickest: float, overlap: float, degrees: float = 5.0) -> DataFrame:
    """(a, b, thickness, length, x0, y0, x1, y1): faces a < b that could bound one wall, with its axis.

    ``faces`` has id and the ends of each line, x0, y0, x1, y1. Two face each other where they are parallel within
    ``degrees``, lie beside each other for ``overlap`` at least, and are ``thinnest`` to ``thickest`` apart all along, measured
    by the normal of a from a itself, so the origin has no part in it. Thickness is that in the middle of the overlap.

    Lines meet in cells: points along b are no further than ``overlap`` apart, so some point of each lies within
    ``thickest + overlap`` of one of the other. A face is in the cells that it passes, and asks those that come so near; cells are
    wide, so both are few. Rows with a null and lines without length are left out.
    """
    reach = thickest + overlap
    size = WIDTH * reach
    faces = faces.select("id", *(F.col(c).cast("double").alias(c) for c in ENDS)).dropna().where("x0 <> x1 or y0 <> y1")
    for c in faces.columns:
        faces = faces.where(F.col(c).isNotNull())  # as the plan does not take it from dropna, and would test each value
    faces = faces.repartition("id").withColumn("length", _length())  # one shuffle for both sides
    two = faces.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ENDS), F.explode_outer(_cells(overlap, size, 0.0)).alias("cell"))
    asked = faces.select(F.col("id").alias("a"), *ENDS, F.explode_outer(_cells(overlap, size, reach)).alias("cell"))
    close = F.col("a") < F.col("b")
    for c in "xy":
        (lo, hi), (b_lo, b_hi) = ([f(f"{p}{c}0", f"{p}{c}1") for f in (F.least, F.greatest)] for p in ("", "b_"))
        close &= (b_lo <= hi + 1.01 * thickest) & (lo <= b_hi + 1.01 * thickest)
    # Where b's ends lie along and beside a.
    at = []
    for k in (0, 1):
        px, py = F.col(f"b_x{k}") - F.col("x0"), F.col(f"b_y{k}") - F.col("y0")
        at += [(px * F.col("ux") + py * F.col("uy")).alias(f"s{k}"), (py * F.col("ux") - px * F.col("uy")).alias(f"w{k}")]
    # Merged: a plan takes exploded cells to be as small as the faces, and would send all of them through the driver. The join tests boxes
    # only, and pairs, one row each although they meet in several cells, the rest: in one stage its code would be too long to be compiled.
    near = asked.join(two.hint("merge"), "cell").where(close).withColumn("length", _length())
    near = near.withColumns({f"u{a}": (F.col(f"{a}1") - F.col(f"{a}0")) / F.col("length") for a in "xy"})
    pairs = near.select("a", "b", "x0", "y0", "ux", "uy", "length", *at).dropDuplicates(["a", "b"])
    parallel = F.abs(F.col("w1") - F.col("w0")) <= math.tan(math.radians(degrees)) * F.abs(F.col("s1") - F.col("s0"))
    lo, hi = F.greatest(F.lit(0.0), F.least("s0", "s1")), F.least(F.col("length"), F.greatest("s0", "s1"))
    pairs = pairs.where(parallel & (hi - lo >= overlap))
    pairs = pairs.withColumns({"lo": lo, "hi": hi})

    def beside(at: Column) -> Column:
        return F.col("w0") + (F.col("w1") - F.col("w0")) * (at - F.col("s0")) / (F.col("s1") - F.col("s0"))

    pairs = pairs.withColumns({"wl": beside(F.col("lo")), "wh": beside(F.col("hi"))})
    apart = (F.col("wl") * F.col("wh") > 0) & (F.least(F.abs("wl"), F.abs("wh")) >= thinnest) & (F.greatest(F.abs("wl"), F.abs("wh")) <= thickest)

    def axis(along: str, by: str) -> tuple[Column, Column]:
        return F.col("x0") + F.col("ux") * F.col(along) - F.col("uy") * F.col(by) / 2, F.col("y0") + F.col("uy") * F.col(along) + F.col("ux") * F.col(by) / 2

    ends = dict(zip(ENDS, (*axis("lo", "wl"), *axis("hi", "wh"))))
    thickness = F.round(F.abs(F.col("wl") + F.col("wh")) / 2, 9)
    return pairs.where(apart).select("a", "b", thickness.alias("thickness"), (F.col("hi") - F.col("lo")).alias("length"), *(c.alias(k) for k, c in ends.items()))


def walls(faces: DataFrame, thinnest: float, thickest: float, overlap: float, degrees: float = 5.0) -> DataFrame:
    """The pairs of :func:`facing` in which each face is the other's nearest; of equally near ones that with the smaller id.

    A face bounds one wall at most. Both choices are aggregates over a face's pairs, of which only the best is carried.
    """
    pairs = facing(faces, thinnest, thickest, overlap, degrees)
    own = F.explode(F.array(*(F.struct(F.col(p).alias("face"), F.col(q).alias("other")) for p, q in (("a", "b"), ("b", "a")))))
    best = pairs.withColumn("f", own).groupBy("f.face").agg(F.min_by(F.struct("*"), F.struct("thickness", "f.other")).alias("r"))
    both = Window.partitionBy("r.a", "r.b")  # two rows at most
    kept = best.withColumn("n", F.count("*").over(both)).where((F.col("n") == 2) & (F.col("face") == F.col("r.a")))
    return kept.select("r.*").drop("f")
