"""Queries that are built from the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import keeps, sample_offset
from ..operators import cleaning
from ..operators.indexing import order_statistics
from ..operators.spatial import k_nearest
from ..session import cut
from .fixtures import view

#: Points of a robust range: every ceil(n / RANGE_POINTS)-th.
RANGE_POINTS = 50_000
STRIDE = 16
FLOATER = 3
RADIUS = 0.08
CELL = 0.06
SHARES = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "lo": 0.0, "hi": 1.0}


def _vectors(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return view(spark, sf_dir, "vec_points").where(where).withColumnRenamed("vec_id", "id")


def sample_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points").where(keeps(F.col("point_idx"), STRIDE)).select("point_idx", "x", "y", "z")


def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points").select("point_idx", sample_offset(F.col("point_idx"), STRIDE).alias("kept_offset"))


def percentile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, out = view(spark, sf_dir, "points"), None
    for axis in "xyz":
        row = order_statistics(points, axis, SHARES).select(F.lit(axis).alias("axis"), *SHARES)
        out = row if out is None else out.unionByName(row)
    return out


def robust_axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, out = view(spark, sf_dir, "points"), None
    stride = max(1, -(-points.count() // RANGE_POINTS))
    points = points.where(F.col("point_idx") % stride == 0)
    for axis in "xyz":
        row = order_statistics(points, axis, {"a": 0.005, "b": 0.995}).select(F.lit(axis).alias("axis"), (F.col("b") - F.col("a")).alias("extent"))
        out = row if out is None else out.unionByName(row)
    return out


def robust_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_statistics(view(spark, sf_dir, "points"), "z", {"floor_z": 0.05})


def floater_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points further from the median than three times the 95th percentile of that distance."""
    points = view(spark, sf_dir, "points")
    mid = [order_statistics(points, a, {"m": 0.5}).first()["m"] for a in "xyz"]
    d2 = sum((((F.col(a) - m) * (F.col(a) - m)) for a, m in zip("xyz", mid)), F.lit(0.0))
    d = points.select(F.sqrt(d2).alias("d"))
    core = order_statistics(d, "d", {"p95": 0.95}).first()["p95"]
    return d.agg(F.lit(core).alias("p95"), F.count(F.when(F.col("d") > FLOATER * core, 1)).alias("floaters"), F.count("*").alias("n"))


def knn_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_nearest(_vectors(spark, sf_dir), 4, RADIUS).select("id", "other", "rank", F.round("d2", 9).alias("d2"))


def radius_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.radius_outliers(_vectors(spark, sf_dir), RADIUS, 3)


def sor_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.statistical_outliers(_vectors(spark, sf_dir), 6, 1.0, RADIUS)


def median_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = k_nearest(_vectors(spark, sf_dir), 1, RADIUS).select(F.sqrt("d2").alias("d"))
    return order_statistics(near, "d", {"m": 0.5}).select(F.round("m", 9).alias("spacing"))


def _deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.deviation(_vectors(spark, sf_dir, "vec_id % 2 = 1"), _vectors(spark, sf_dir, "vec_id % 2 = 0"), 0.1)


def deviation_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deviation(spark, sf_dir).select("id", "other", F.round("d", 9).alias("d"))


def deviation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest, mean and root mean square of the deviations, and the percentiles at 50 and 95."""
    d, found = F.col("d"), cut(_deviation(spark, sf_dir))
    row = found.agg(
        F.count("d").alias("matched"), F.round(F.min(d), 9).alias("lo"), F.round(F.max(d), 9).alias("hi"),
        F.round(F.avg(d), 7).alias("mean"), F.round(F.sqrt(F.avg(d * d)), 7).alias("rms"),
    )
    at = order_statistics(found, "d", {"p50": 0.5, "p95": 0.95})
    return row.crossJoin(F.broadcast(at.select(*(F.round(c, 9).alias(c) for c in at.columns))))  # one row each


def icp_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, ref = _vectors(spark, sf_dir, "vec_id % 2 = 1"), _vectors(spark, sf_dir, "vec_id % 2 = 0")
    near = _deviation(spark, sf_dir).where("other is not null")
    ref = ref.select(F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))
    row = cleaning.rigid_step(own.join(near, "id").join(ref, "other"))
    return row.select("n", *(F.round(c, 8).alias(c) for c in row.columns if c != "n"))


def _labelled(df: DataFrame) -> DataFrame:
    """Labels as the smallest point id of each component: comparable between engines."""
    least = df.groupBy("label").agg(F.min("id").alias("component"))
    return df.join(least, "label").select("id", "component")


def voxel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(cleaning.clusters(_vectors(spark, sf_dir), CELL))


def magic_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.wand(_vectors(spark, sf_dir, "abs(z) >= 0.01 or vec_id = 0"), 0, CELL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sample_budget, sample_hash, percentile_stats, robust_axis_range, robust_floor, floater_share, knn_self, radius_outlier,
        sor_clean, median_spacing, deviation_nn, deviation_stats, icp_covariance, voxel_components, magic_wand,
    )
}

_LOW = "CAST({0} - floor({0} / 4294967296.0::DOUBLE) * 4294967296.0::DOUBLE AS BIGINT)"
_H1 = _LOW.format("(CAST(w AS DOUBLE) * 2654435761.0::DOUBLE)")
_H3 = _LOW.format("(CAST(CASE WHEN h2 >= 2147483648 THEN h2 - 4294967296 ELSE h2 END AS DOUBLE) * 2246822519.0::DOUBLE)")
_OFFSET = f"(SELECT *, xor(h3, h3 >> 13) % 16 AS o FROM (SELECT *, {_H3} AS h3 FROM (SELECT *, xor(h1, h1 >> 15) AS h2 FROM (SELECT *, {_H1} AS h1 FROM (SELECT *, @w AS w FROM {{points}})))))"
_RANK = "(SELECT '{0}' AS axis, {0} AS v, row_number() OVER (ORDER BY {0}) - 1 AS r, count(*) OVER () AS n FROM {1})"
_ALL = " UNION ALL ".join("SELECT * FROM " + _RANK.format(a, "{points}") for a in ("x", "y", "z"))
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_KNN = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS other, {_D2} AS d2 FROM {{vec_points}} a JOIN {{vec_points}} b ON a.vec_id <> b.vec_id))"
_DEV = f"(SELECT a.vec_id AS id, m.other, m.d FROM (SELECT * FROM {{vec_points}} WHERE vec_id % 2 = 1) a LEFT JOIN (SELECT id, arg_min(other, (d2, other)) AS other, sqrt(min(d2)) AS d FROM (SELECT a.vec_id AS id, b.vec_id AS other, {_D2} AS d2 FROM {{vec_points}} a JOIN {{vec_points}} b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0) WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY id) m ON a.vec_id = m.id)"


def _at(share: float) -> str:
    return f"max(CASE WHEN r = floor((n - 1) * {share}::DOUBLE) THEN v END)"


def _reach(where: str) -> str:
    """Recursive SQL: pairs of a cell and the smallest cells that reach it."""
    return (
        "WITH RECURSIVE c AS (SELECT vec_id AS id, CAST(floor(x / 0.06) AS BIGINT) AS i, CAST(floor(y / 0.06) AS BIGINT) AS j, CAST(floor(z / 0.06) AS BIGINT) AS k FROM {vec_points} WHERE "
        + where
        + "), g AS (SELECT i, j, k, min(id) AS node FROM c GROUP BY i, j, k), "
        "e AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1), "
        "reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), "
        "l AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a), "
        "p AS (SELECT c.id, l.component FROM c JOIN g USING (i, j, k) JOIN l USING (node)) "
    )


ORACLES: dict[str, str] = {
    "sample_budget": f"SELECT point_idx, x, y, z FROM {_OFFSET.replace('@w', 'floor(point_idx / 16)')} WHERE point_idx - w * 16 = o",
    "sample_hash": f"SELECT point_idx, o AS kept_offset FROM {_OFFSET.replace('@w', 'point_idx')}",
    "percentile_stats": "SELECT axis, " + ", ".join(f"{_at(p)} AS {k}" for k, p in SHARES.items()) + f" FROM ({_ALL}) GROUP BY axis",
    "robust_axis_range": f"SELECT axis, {_at(0.995)} - {_at(0.005)} AS extent FROM (" + " UNION ALL ".join("SELECT * FROM " + _RANK.format(a, "(SELECT * FROM {points} WHERE point_idx % (SELECT greatest(1, CAST(ceil(count(*) / 50000.0) AS BIGINT)) FROM {points}) = 0)") for a in ("x", "y", "z")) + ") GROUP BY axis",
    "robust_floor": f"SELECT {_at(0.05)} AS floor_z FROM {_RANK.format('z', '{points}')}",
    "floater_share": "WITH m AS (SELECT " + ", ".join(f"(SELECT {_at(0.5)} FROM {_RANK.format(a, '{points}')}) AS m{a}" for a in "xyz") + f"), d AS (SELECT sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d FROM {{points}}, m), q AS (SELECT {_at(0.95)} AS p95 FROM (SELECT d AS v, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM d)) SELECT max(p95) AS p95, count(CASE WHEN d > 3 * p95 THEN 1 END) AS floaters, count(*) AS n FROM d, q",
    "knn_self": f"SELECT id, other, CAST(rank AS INTEGER) AS rank, round(d2, 9) AS d2 FROM {_KNN} WHERE rank <= 4",
    "radius_outlier": f"SELECT id, count(*) AS n FROM {_KNN} WHERE d2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE GROUP BY id HAVING count(*) >= 3",
    "sor_clean": f"WITH m AS (SELECT id, avg(sqrt(d2)) AS d FROM {_KNN} WHERE rank <= 6 GROUP BY id) SELECT id FROM m, (SELECT avg(d) + 1.0 * stddev_samp(d) AS lim FROM m) WHERE round(d - lim, 9) <= 0",
    "median_spacing": f"SELECT round({_at(0.5)}, 9) AS spacing FROM (SELECT sqrt(d2) AS v, row_number() OVER (ORDER BY d2) - 1 AS r, count(*) OVER () AS n FROM {_KNN} WHERE rank = 1)",
    "deviation_nn": f"SELECT id, other, round(d, 9) AS d FROM {_DEV}",
    "deviation_stats": f"SELECT count(v) AS matched, round(min(v), 9) AS lo, round(max(v), 9) AS hi, round(avg(v), 7) AS mean, round(sqrt(avg(v * v)), 7) AS rms, round({_at(0.5)}, 9) AS p50, round({_at(0.95)}, 9) AS p95 FROM (SELECT d AS v, row_number() OVER (ORDER BY d NULLS LAST) - 1 AS r, count(d) OVER () AS n FROM {_DEV})",
    "icp_covariance": "SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 8) AS m_{c}" for c in "xyzuvw") + ", " + ", ".join(f"round(covar_pop({a}, {b}), 8) AS c_{a}{b}" for a in "xyz" for b in "uvw") + f" FROM (SELECT p.x, p.y, p.z, q.x AS u, q.y AS v, q.z AS w FROM {_DEV} d JOIN {{vec_points}} p ON d.id = p.vec_id JOIN {{vec_points}} q ON d.other = q.vec_id)",
    "voxel_components": _reach("true") + "SELECT p.id, m.component FROM p JOIN (SELECT component AS c0, min(id) AS component FROM p GROUP BY component) m ON p.component = m.c0",
    "magic_wand": _reach("abs(z) >= 0.01 OR vec_id = 0") + "SELECT id FROM p WHERE component = (SELECT component FROM p WHERE id = 0)",
}
