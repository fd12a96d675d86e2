"""Point-cloud pipelines from a specification: a list of named stages with typed arguments, checked as a whole, then one plan.

A specification is a list, or JSON of one, of objects with a ``type`` and the stage's arguments:

    [{"type": "read", "path": "/scans"}, {"type": "slab", "axis": "z", "at": 1.2, "thickness": 0.1}, {"type": "write_cloud", "path": "/cut"}]

:func:`check` goes through it without starting a job: an unknown stage or argument, a wrong type, a value out of range, a missing
argument, a column that no earlier stage gives, a reader behind another stage or a writer before one is :class:`SpecError`,
and it names the stage's position. :func:`run` checks, unites the readers' clouds (or begins from a given DataFrame with ``id``,
``x``, ``y`` and ``z``), applies the stages in turn and writes. Stages are DataFrame expressions, so Catalyst sees one plan; only
those that count or iterate (components, neighbours, numbering) run jobs while it is built.
"""

from __future__ import annotations

import inspect
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ramp
from ..sources import exports, pointcloud
from . import cleaning, clipping, normals, surfaces
from .indexing import with_index

Axis = Literal["x", "y", "z"]
READ, STEP, WRITE = "read", "step", "write"
PLACES = ("id", "x", "y", "z")


class SpecError(ValueError):
    """A specification that cannot be run."""


@dataclass(frozen=True)
class Stage:
    """A stage's function, its kind, the columns that it needs and adds, arguments above 0, and all of them with type and default."""

    apply: Callable
    kind: str
    needs: tuple[str, ...]
    adds: tuple[str, ...]
    positive: tuple[str, ...]
    arguments: dict[str, tuple[type, object]]
    validate: Callable[..., str | None] | None = None


STAGES: dict[str, Stage] = {}


def stage(name: str, kind: str = STEP, needs: tuple[str, ...] = ("x", "y", "z"), adds: tuple[str, ...] = (), positive: tuple[str, ...] = (), validate: Callable[..., str | None] | None = None):
    """Register a function of a DataFrame (readers: of a session); its annotated parameters are the stage's arguments.

    ``validate`` gets the arguments and says what is wrong with them, if anything.
    """

    def register(f: Callable) -> Callable:
        hints = get_type_hints(f)
        own = list(inspect.signature(f).parameters.values())[1:]
        STAGES[name] = Stage(f, kind, needs, adds, positive, {p.name: (hints[p.name], p.default) for p in own}, validate)
        return f

    return register


def fits(value: object, kind: object) -> bool:
    """Whether a JSON value is of an annotated type; a whole number is a float too, true and false are no numbers."""
    origin = get_origin(kind)
    if origin is Literal:
        return value in get_args(kind)
    if origin is list:
        return isinstance(value, list) and all(fits(v, get_args(kind)[0]) for v in value)
    if origin is tuple:
        return isinstance(value, list) and len(value) == len(get_args(kind)) and all(map(fits, value, get_args(kind)))
    if kind is bool or isinstance(value, bool):
        return kind is bool and isinstance(value, bool)
    if kind is float:
        return isinstance(value, (int, float)) and math.isfinite(value)
    return isinstance(value, kind)


def said(kind: object) -> str:
    return kind.__name__ if isinstance(kind, type) and get_origin(kind) is None else str(kind).replace("typing.", "")


def check(spec: str | list, columns: list[str] | None = None) -> list[tuple[Stage, dict]]:
    """The stages with their arguments; ``columns`` are those of a given DataFrame, None where the first stages read."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise SpecError(f"not JSON: {e}") from e
    if not isinstance(spec, list) or not spec:
        raise SpecError("a specification is a list of stages")
    there, before, out = set(columns or ()), READ, []
    for at, given in enumerate(spec):
        where = f"stage {at}"
        if not isinstance(given, dict) or not isinstance(given.get("type"), str):
            raise SpecError(f"{where}: an object with a type is wanted")
        where = f"{where} ({given['type']})"
        found = STAGES.get(given["type"])
        if found is None:
            raise SpecError(f"{where}: no such stage; there are {', '.join(sorted(STAGES))}")
        values = {k: v for k, v in given.items() if k != "type"}
        if unknown := sorted(set(values) - set(found.arguments)):
            raise SpecError(f"{where}: unknown {', '.join(unknown)}; it takes {', '.join(found.arguments) or 'nothing'}")
        for name, (kind, default) in found.arguments.items():
            if name not in values:
                if default is inspect.Parameter.empty:
                    raise SpecError(f"{where}: {name} is missing")
            elif not fits(values[name], kind):
                raise SpecError(f"{where}: {name} must be {said(kind)}, not {values[name]!r}")
            elif name in found.positive and values[name] <= 0:
                raise SpecError(f"{where}: {name} must be above 0, not {values[name]!r}")
        if found.validate and (wrong := found.validate(**values)):
            raise SpecError(f"{where}: {wrong}")
        if found.kind == READ and (before != READ or columns is not None):
            raise SpecError(f"{where}: a reader comes first, and not beside a given table")
        if found.kind != WRITE and before == WRITE:
            raise SpecError(f"{where}: nothing comes behind a writer")
        if found.kind != READ and columns is None and at == 0:
            raise SpecError(f"{where}: there is nothing to work on; begin with a reader")
        named = {values[k] for k in ("column",) if found.kind != READ and k in values and given["type"] != "assign"}
        if found.kind != READ and (lost := sorted((set(found.needs) | named) - there)):
            raise SpecError(f"{where}: no column {', '.join(lost)}")
        there |= set(found.adds) | ({values["column"]} if given["type"] == "assign" else set())
        if given["type"] == "select":
            if lost := sorted(set(values["columns"]) - there):
                raise SpecError(f"{where}: no column {', '.join(lost)}")
            there = set(values["columns"])
        before = found.kind
        out.append((found, _fixed(values, found)))
    return out


def _fixed(values: dict, found: Stage) -> dict:
    """Whole numbers as floats where these are meant."""
    return {k: float(v) if found.arguments[k][0] is float else v for k, v in values.items()}


def run(spark: SparkSession, spec: str | list, points: DataFrame | None = None) -> DataFrame:
    """The last stage's rows; writers pass them on."""
    checked = check(spec, None if points is None else points.columns)
    read = [s.apply(spark, **values) for s, values in checked if s.kind == READ]
    if read:
        points = read[0]
        for more in read[1:]:
            points = points.unionByName(more)
        points = with_index(points, ["cloud", "scan_id", "point_idx"], "id")
    for found, values in checked[len(read) :]:
        points = found.apply(points, **values)
    return points


# Readers and writers --------------------------------------------------------------------------------------------------
@stage("read", READ, adds=(*PLACES, "cloud", "scan_id", "point_idx", "r", "g", "b", "intensity", "classification"), positive=("stride", "budget"))
def read(spark: SparkSession, path: str, stride: int = 1, budget: int = 0) -> DataFrame:
    """Cloud files; ids number the points of all readers by cloud, scan and place."""
    pointcloud.register(spark)
    reader = spark.read.format("pointcloud").option("stride", stride)
    return (reader.option("maxPoints", budget) if budget else reader).load(path)


@stage("write_cloud", WRITE)
def write_cloud(points: DataFrame, path: str, form: Literal["ply", "las", "xyz"] = "ply") -> DataFrame:
    pointcloud.register(points.sparkSession)
    kept = [c for c in ("x", "y", "z", "r", "g", "b", "intensity", "classification") if c in points.columns]
    points.select(*kept).write.format("pointcloud").option("form", form).mode("overwrite").save(path)
    return points


@stage("write_raster", WRITE, positive=("cell", "side"))
def write_raster(points: DataFrame, path: str, cell: float, highest: bool = True, side: int = exports.SIDE) -> DataFrame:
    exports.write_raster(surfaces.height_grid(points, cell, highest), path, cell, side)
    return points


@stage("write_table", WRITE, needs=())
def write_table(points: DataFrame, path: str) -> DataFrame:
    points.write.mode("overwrite").parquet(path)
    return points


# Rows and columns -----------------------------------------------------------------------------------------------------
@stage("range", needs=())
def keep_range(points: DataFrame, column: str, low: float = -math.inf, high: float = math.inf, outside: bool = False) -> DataFrame:
    """Rows whose value is in the closed range, or (``outside``) is not; null is in no range."""
    within = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return points.where(~within if outside else within)


@stage("classes", needs=("classification",))
def keep_classes(points: DataFrame, keep: list[int]) -> DataFrame:
    return points.where(F.col("classification").isin(keep))


@stage("decimate", needs=("id",), positive=("step",))
def decimate(points: DataFrame, step: int, offset: int = 0) -> DataFrame:
    return points.where(F.pmod(F.col("id") - offset, F.lit(step)) == 0)


@stage("select", needs=())
def select(points: DataFrame, columns: list[str]) -> DataFrame:
    return points.select(*columns)


@stage("assign", needs=())
def assign(points: DataFrame, column: str, value: float) -> DataFrame:
    return points.withColumn(column, F.lit(value))


def _affine(matrix: list[float]) -> str | None:
    return None if len(matrix) == 16 and matrix[12:] == [0, 0, 0, 1] else "matrix must be four rows of four, the last 0, 0, 0, 1"


@stage("transform", validate=_affine)
def transform(points: DataFrame, matrix: list[float]) -> DataFrame:
    """x, y, z by a matrix of four rows."""
    moved = {a: sum((F.col(b) * float(matrix[4 * k + n]) for n, b in enumerate("xyz")), F.lit(0.0)) + float(matrix[4 * k + 3]) for k, a in enumerate("xyz")}
    return points.withColumns(moved)


@stage("ramp", needs=(), adds=("r", "g", "b"))
def colour_ramp(points: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Colours of a column's values between two that are blue and red; a range of no width is blue."""
    t = F.lit(0.0) if high == low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low) / (high - low)))
    return points.withColumns({c: v for c, v in zip("rgb", ramp(t))})


# Clips ----------------------------------------------------------------------------------------------------------------
@stage("slab", positive=("thickness",))
def slab(points: DataFrame, axis: Axis, at: float, thickness: float) -> DataFrame:
    return points.where(clipping.slab(F.col(axis), at, thickness))


@stage("box")
def box(points: DataFrame, centre: tuple[float, float, float], half: tuple[float, float, float]) -> DataFrame:
    return points.where(clipping.box(F.col("x"), F.col("y"), F.col("z"), centre, half))


@stage("sphere", positive=("radius",))
def sphere(points: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    return points.where(clipping.sphere(F.col("x"), F.col("y"), F.col("z"), centre, radius))


@stage("polygon", validate=lambda ring: None if len(ring) > 2 else "ring must have three corners or more")
def polygon(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    return points.where(clipping.polygon(F.col("x"), F.col("y"), ring))


# Neighbourhoods -------------------------------------------------------------------------------------------------------
@stage("voxel", needs=PLACES, positive=("size",))
def voxel(points: DataFrame, size: float = cleaning.VOXEL) -> DataFrame:
    return cleaning.thin(points, size)


@stage("statistical", needs=PLACES, positive=("k", "std", "radius"))
def statistical(points: DataFrame, radius: float, k: int = cleaning.NEIGHBOURS, std: float = cleaning.DEVIATIONS) -> DataFrame:
    return points.join(cleaning.statistical_outliers(points, k, std, radius), "id", "left_semi")


@stage("radius", needs=PLACES, positive=("radius", "least"))
def radius_filter(points: DataFrame, radius: float, least: int) -> DataFrame:
    return points.join(cleaning.radius_outliers(points, radius, least), "id", "left_semi")


@stage("largest", needs=PLACES, positive=("size",))
def largest(points: DataFrame, size: float) -> DataFrame:
    return points.join(cleaning.largest(points, size), "id", "left_semi")


@stage("cluster", needs=PLACES, adds=("cluster",), positive=("radius", "least"))
def cluster(points: DataFrame, radius: float, least: int) -> DataFrame:
    return points.drop("cluster").join(cleaning.dbscan(points, radius, least), "id")


@stage("normals", needs=PLACES, adds=("nx", "ny", "nz"), positive=("k", "radius"))
def add_normals(points: DataFrame, k: int, radius: float) -> DataFrame:
    return points.drop("nx", "ny", "nz").join(normals.normals(points, k, radius), "id")
