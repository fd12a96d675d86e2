"""Normals of points from their neighbours, and comparison of clouds with a sign."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import deviation, thin
from .spatial import AXES, k_nearest

COVARIANCE = ("xx", "xy", "xz", "yy", "yz", "zz")
#: Share of the spread below which two extents of a neighbourhood are the same: it has no normal. The angle is known to 1e-8.
FLAT = 1e-6


def local_covariance(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, xx, xy, xz, yy, yz, zz, n): covariances of each point and its k nearest others, about their mean.

    Differences to the point itself are summed, so clouds far from the origin lose no digits; one join brings the neighbours'
    places, one aggregate sums them.
    """
    near = k_nearest(points, k, radius).select("id", "other")
    there = points.select(F.col("id").alias("other"), *(F.col(a).alias(f"o{a}") for a in AXES))
    rows = near.join(there, "other").join(points.select("id", *AXES), "id")
    d = {a: F.col(f"o{a}") - F.col(a) for a in AXES}
    sums = rows.groupBy("id").agg(F.count("*").alias("m"), *(F.sum(d[a]).alias(f"s{a}") for a in AXES), *(F.sum(d[p[0]] * d[p[1]]).alias(f"q{p}") for p in COVARIANCE))
    n = F.col("m") + 1  # the point itself is at distance zero
    return sums.select("id", *((F.col(f"q{p}") / n - F.col(f"s{p[0]}") / n * (F.col(f"s{p[1]}") / n)).alias(p) for p in COVARIANCE), n.alias("n"))


def least_direction(rows: DataFrame) -> DataFrame:
    """``rows`` with nx, ny, nz: the unit eigenvector of the smallest eigenvalue of xx, xy, xz, yy, yz, zz; null if it is not single.

    Eigenvalues of a symmetric 3 x 3 matrix in closed form, by the angle whose triple cosine is half the determinant of
    the scaled matrix; the vector is the longest cross product of two rows of the matrix less the eigenvalue. Expressions only.
    """
    keep = rows.columns
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in COVARIANCE)
    out = rows.withColumn("__q", (xx + yy + zz) / 3)
    q = F.col("__q")
    out = out.withColumn("__p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    p = F.col("__p")
    a, b, c = xx - q, yy - q, zz - q
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (p * p * p) / 2
    out = out.withColumn("__t", F.when(p > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3))
    out = out.withColumn("__l", q + 2 * p * F.cos(F.col("__t") + 2 * math.pi / 3)).withColumn("__m", 3 * q - F.col("__l") - (q + 2 * p * F.cos(F.col("__t"))))
    low = F.col("__l")
    r = [(xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)]

    def cross(u: tuple, v: tuple) -> Column:
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        return F.struct((x * x + y * y + z * z).alias("s"), x.alias("x"), y.alias("y"), z.alias("z"))

    out = out.withColumn("__v", F.greatest(*(cross(r[i], r[j]) for i, j in ((0, 1), (0, 2), (1, 2)))))
    single = (F.col("__m") - low > FLAT * q) & (F.col("__v.s") > 0)
    return out.select(*keep, *(F.when(single, F.col(f"__v.{k}") / F.sqrt("__v.s")).alias(f"n{k}") for k in AXES))


def normals(points: DataFrame, k: int, radius: float, towards: tuple[float, float, float] | None = None) -> DataFrame:
    """(id, nx, ny, nz): unit normals of the neighbourhoods of k points, null where they have none (on a line, in a heap).

    They point to ``towards``, a scanner's place, or else up: the last of z, y, x that is not zero is positive.
    """
    found = least_direction(local_covariance(points, k, radius))
    if towards is None:
        side = F.when(F.col("nz") != 0, F.col("nz")).when(F.col("ny") != 0, F.col("ny")).otherwise(F.col("nx"))
    else:
        found = found.join(points.select("id", *AXES), "id")
        side = sum(((F.lit(t) - F.col(a)) * F.col(f"n{a}") for a, t in zip(AXES, towards)), F.lit(0.0))
    return found.select("id", *((F.when(side < 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}"))).alias(f"n{a}") for a in AXES))


def signed_deviation(
    compared: DataFrame, reference: DataFrame, most: float, k: int, radius: float, voxel: float | None = None, towards: tuple[float, float, float] | None = None
) -> DataFrame:
    """(id, other, d): the nearest reference point within ``most``; d is negative behind the reference surface.

    The side is that of the reference point's normal. Where it has none, or the point lies in its surface, d is not negative.
    With ``voxel`` one compared point of each voxel counts. Points without a reference point have null.
    """
    compared = compared.select("id", *AXES)
    if voxel:
        compared = thin(compared, voxel)
    near = deviation(compared, reference, most)
    hit = reference.select(F.col("id").alias("other"), *(F.col(a).alias(f"o{a}") for a in AXES))
    facing = normals(reference, k, radius, towards).withColumnRenamed("id", "other")
    rows = near.join(compared, "id").join(hit, "other", "left").join(facing, "other", "left")
    side = sum(((F.col(a) - F.col(f"o{a}")) * F.col(f"n{a}") for a in AXES), F.lit(0.0))
    return rows.select("id", "other", F.when(side < 0, -F.col("d")).otherwise(F.col("d")).alias("d"))
