"""Text clouds of any size: point lists (xyz, pts, txt, csv) and grids (ptx), read in ranges.

Spark's text source reads the lines of a file in ranges; a line's place in its file is its place in the range and the lines of the ranges
before, one sum a range. Layouts, totals, maxima and the borders of scans come from aggregates over all ranges, so
a file gives the same rows, numbers and scaling as by its whole read in one task (``formats.text_points``, ``formats.ptx_points``).
No task holds more than it streams, and a window sorts at most one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import keeps
from ..session import cut
from . import formats

LISTS, GRIDS = r"(?i)\.(xyz|pts|txt|csv|xyzrgb)$", r"(?i)\.ptx$"
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
#: Lines of a scan before its grid, and the first of the four of its matrix.
HEAD, MATRIX = 10, 6
#: The floor of a budget of points.
LEAST_BUDGET = 200_000
NAN = float("nan")


def _read(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file, block, value): lines with the range they are read in."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("_metadata.file_path").rlike(names))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def lines(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file, block, at, value): lines with the range they are read in, in order of (block, at)."""
    return _read(spark, path, names).select("file", "block", F.monotonically_increasing_id().alias("at"), "value")


def numbered(rows: DataFrame) -> DataFrame:
    """``no``: the place of each row in its file, from 0."""
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("here", here).join(bases, ["file", "block"]).withColumn("no", F.col("base") + F.col("here") - 1).drop("here", "base")


def _number(token: Column) -> Column:
    token = F.trim(token)
    return F.when(token.rlike(NUMBER), token.cast("double")).otherwise(NAN)


def _clipped(v: Column, by: Column) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / by))).cast("float")


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each file by the line that decides: its names, or the extension and number of columns."""
    for batch in batches:
        found = []
        for file, words, n in zip(*(batch.column(c).to_pylist() for c in ("file", "words", "n"))):
            found.append(formats.text_layout(file, n) if words is None else formats.named_layout(words))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("first"), pa.array(found, pa.list_(pa.string()))], ["file", "first", "layout"])


def _tops() -> list[Column]:
    """The largest colour and intensity of a group of rows, 0 at least, and their number."""
    top = lambda c: F.coalesce(F.max(F.when(~F.isnan(c), F.col(c))), F.lit(0.0))
    return [F.greatest(top("r"), top("g"), top("b"), F.lit(0.0)).alias("colour"), F.greatest(top("intensity"), F.lit(0.0)).alias("most"), F.count("*").alias("total")]


def _scaled(rows: DataFrame, has: dict[str, Column], by_modulo: bool, budget: int | None, stride: int, with_file: bool = False) -> DataFrame:
    """Rows (file, no, scan_id, x, y, z, r, g, b, intensity, classification, colour, most, total) scaled by what their file holds, sampled."""
    by = F.when(F.col("colour") > 255, 65535.0).when(F.col("colour") > 1.0001, 255.0).otherwise(1.0)
    label = F.when(F.isnan("classification"), 0.0).otherwise(F.col("classification"))
    step = F.lit(stride)
    if budget:
        most = max(budget, LEAST_BUDGET)
        step = F.when(F.col("total") > most, F.ceil(F.col("total") / most)).otherwise(1)
    good = F.lit(True)
    for a in "xyz":
        good &= ~F.isnan(a) & (F.abs(a) < float("inf"))
    if budget or stride > 1:
        chosen = F.col("no") % step == 0 if by_modulo else keeps(F.col("no"), step)
        good &= (F.col("step") <= 1) | chosen
    out = rows.withColumn("step", step.cast("long")).where(good)
    return out.select(
        *(["file"] if with_file else []), F.element_at(F.split("file", "/"), -1).alias("cloud"), F.col("scan_id").cast("int").alias("scan_id"), F.col("no").alias("point_idx"), "x", "y", "z",
        *(F.when(has["rgb"], _clipped(F.col(c), by)).alias(c) for c in "rgb"),
        F.when(has["intensity"], _clipped(F.col("intensity"), F.when(F.col("most") > 1.0001, F.col("most")).otherwise(1.0))).alias("intensity"),
        F.when(has["classification"], F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(label + 0.5).cast("double"))).cast("short")).alias("classification"),
    )


def read_lists(spark: SparkSession, path: str, budget: int | None = None, stride: int = 1, names: str = LISTS) -> DataFrame:
    """The points of lists in files or folders, with the columns of the ``pointcloud`` source; ``budget`` points a file at most.

    ``names`` is a pattern of the paths that are taken.
    """
    rows = _read(spark, path, names)
    data = F.col("value").rlike(r"^﻿?\s*[-+]?(\d|\.\d)")
    bare = F.regexp_replace(F.regexp_replace("value", r"^\s+|\s+$", ""), "^﻿+", "")
    filled = lambda tokens: F.filter(tokens, lambda t: F.trim(t) != "")
    split = lambda csv, own, other: F.when(csv, filled(F.split(own, r"[,;\t]+"))).otherwise(F.array_remove(F.split(other, r"[\s,;]+"), ""))
    tokens = lambda csv: split(csv, bare, F.ltrim("value", F.lit("﻿")))
    csv, pts = F.lower("file").endswith(".csv"), F.lower("file").endswith(".pts")
    low = F.lower(bare)
    low = F.when(low.startswith("#"), F.regexp_extract(low, "columns=(.*)$", 1)).otherwise(low)
    words = F.transform(split(csv, low, low), F.trim)
    at, place = F.monotonically_increasing_id().alias("at"), F.struct("block", "at")
    # The first line that names the columns or holds a point decides; the count that a list may begin with does not.
    heads = rows.select("file", "block", at, F.when(data, F.size(tokens(csv))).alias("n"), F.when(~data, words).alias("words"))
    named = F.col("words").isNotNull()
    for axis in "xyz":
        named &= F.arrays_overlap("words", F.array(*map(F.lit, formats.TEXT_NAMES[axis])))
    heads = heads.where(named | (F.col("n").isNotNull() & ~((F.col("n") == 1) & pts)))
    heads = heads.groupBy("file", "block", "n", "words").agg(F.min("at").alias("at"))  # by hashes; a minimum of structs would sort all lines
    heads = heads.groupBy("file").agg(F.min(place).alias("first"), F.min_by(F.struct("n", "words"), place).alias("l")).select("file", "first", "l.*")
    heads = cut(heads.mapInArrow(_layouts, "file string, first struct<block: long, at: long>, layout array<string>"))  # one row a file

    known = {"places": ("x", "y", "z", "classification", "scan_id"), "shades": ("r", "g", "b", "intensity")}
    has = {c: F.array_contains("layout", c) for cs in known.values() for c in cs}
    index = lambda c: F.nullif(F.array_position("layout", c), F.lit(0)).cast("int") - 1
    heads = heads.select(
        "file", csv.alias("csv"), F.when(pts, F.col("first")).alias("first"), *(F.array(*map(index, cs)).alias(k) for k, cs in known.items()),
        (has["r"] & has["g"] & has["b"]).alias("has_rgb"), *(has[c].alias(f"has_{c}") for c in ("intensity", "classification", "scan_id")),
    )
    # A file's layout and a range's sums are broadcast, a row each, so that lines are split where they are read and stay in their order.
    rows = rows.select("file", "block", at, "value").where(data).join(F.broadcast(heads), "file").where(F.col("first").isNull() | (place >= F.col("first")))
    rows = rows.drop("at").select("*", at, tokens(F.col("csv")).alias("tokens")).drop("value", "first", "csv")
    parsed = lambda k: F.transform(k, lambda i: _number(F.get("tokens", i)))
    ranges = rows.select("file", "block", "at", parsed("shades").alias("shades"))
    ranges = ranges.select("file", "block", "at", *(F.col("shades")[i].alias(c) for i, c in enumerate(known["shades"])))
    ranges = ranges.groupBy("file", "block").agg(*_tops(), F.min("at").alias("start"))
    whole = Window.partitionBy("file")  # one row a range
    before = F.coalesce(F.sum("total").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "block", (before - F.col("start")).alias("shift"), F.max("colour").over(whole).alias("colour"), F.max("most").over(whole).alias("most"), F.sum("total").over(whole).alias("total"))
    rows = rows.join(F.broadcast(ranges), ["file", "block"]).withColumn("no", F.col("at") + F.col("shift"))
    # From an array of one, as a plan would repeat the numbers' whole text in each filter of points.
    rows = rows.withColumn("shades", parsed("shades")).withColumn("places", F.explode_outer(F.array(parsed("places"))))
    rows = rows.select("*", *(F.col(k)[i].alias(c) for k, cs in known.items() for i, c in enumerate(cs)))
    rows = rows.withColumn("scan_id", F.when(F.col("has_scan_id"), F.col("scan_id")).otherwise(0.0))
    return _scaled(rows, {c: F.col(f"has_{c}") for c in ("rgb", "intensity", "classification")}, False, budget, stride)


def _scans(rows: DataFrame) -> DataFrame:
    """(file, scan, start, cells) of numbered lines; a file whose scans do not follow one another to its end is an error.

    Only the two lines that begin a scan hold a single number.
    """
    order = Window.partitionBy("file").orderBy("no")
    heads = rows.where(F.size("tokens") == 1).select("file", "no", F.col("tokens")[0].alias("n"))  # two a scan
    heads = heads.withColumns({"k": F.row_number().over(order) - 1, "next": F.lead("no").over(order), "n2": F.lead("n").over(order)}).where("k % 2 = 0")
    whole = F.col("n").rlike(r"^\d{1,9}$") & F.col("n2").rlike(r"^\d{1,9}$")
    cells = F.when(whole & (F.col("next") == F.col("no") + 1), F.col("n").cast("long") * F.col("n2").cast("long"))
    scans = heads.select("file", F.floor(F.col("k") / 2).cast("int").alias("scan"), F.col("no").alias("start"), cells.alias("cells"))
    totals = rows.groupBy("file").agg(F.max("no").alias("last"))
    scans = cut(scans.join(totals, "file", "right"))
    due = F.coalesce(F.lead("start").over(Window.partitionBy("file").orderBy("scan")), F.col("last") + 1)
    bad = scans.withColumn("due", due).where("start is null or cells is null or (scan = 0 and start <> 0) or start + 10 + cells <> due").first()
    if bad:
        raise formats.FormatError(f"{bad['file']}: scan {bad['scan'] or 0} is cut short or is not a grid")
    return scans.drop("last")


def read_grids(spark: SparkSession, path: str, budget: int | None = None, stride: int = 1, names: str = GRIDS, with_file: bool = False) -> DataFrame:
    """The returns of grid files in world coordinates; places without a return (0, 0, 0) have no number.

    ``with_file`` adds the path of the file.
    """
    rows = lines(spark, path, names).withColumn("tokens", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"))
    rows = cut(numbered(rows.where("tokens[0] <> ''").select("file", "block", "at", "tokens")).drop("at"))
    scans = _scans(rows)
    ranges = rows.groupBy("file", "block").agg(F.min("no").alias("low"), F.max("no").alias("high"))
    # Each range with the scans that it holds a part of: few rows, and then an equi-join of the lines.
    held = ranges.join(scans, "file").where("start <= high and start + 10 + cells > low").select("file", "block", "scan", "start", "cells")
    inside = (F.col("no") >= F.col("start")) & (F.col("no") < F.col("start") + HEAD + F.col("cells"))
    placed = rows.join(held, ["file", "block"]).where(inside).withColumn("line", F.col("no") - F.col("start"))
    values = F.transform("tokens", _number)
    matrix = placed.where(F.col("line").between(MATRIX, HEAD - 1)).groupBy("file", "scan")
    matrix = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct("line", values.alias("v")))), lambda s: s["v"]).alias("m"))  # four a scan
    held = held.join(matrix, ["file", "scan"])
    points = rows.join(held, ["file", "block"]).where(inside & (F.col("no") >= F.col("start") + HEAD)).withColumn("v", values)
    get = lambda k: F.coalesce(F.try_element_at("v", F.lit(k + 1)), F.lit(NAN))
    m = [[F.col("m")[i][j] for j in range(4)] for i in range(4)]
    flat = lambda cs: F.greatest(*map(F.abs, cs)) < 1e-8
    by_rows = (flat([m[i][3] for i in range(3)]) & (F.abs(m[3][3] - 1) < 1e-8)) | ~(flat(m[3][:3]) & (F.abs(m[3][3] - 1) < 1e-8))
    p = [get(0), get(1), get(2), F.lit(1.0)]
    world = [F.when(by_rows, sum((p[i] * m[i][k] for i in range(1, 4)), p[0] * m[0][k])).otherwise(sum((p[i] * m[k][i] for i in range(1, 4)), p[0] * m[k][0])) for k in range(3)]
    torn = (F.size("v") > 7) | (F.size("v") < 3)
    points = points.where(torn | ~((get(0) == 0) & (get(1) == 0) & (get(2) == 0)))
    points = points.select("file", "block", F.col("no").alias("at"), F.col("scan").alias("scan_id"), torn.alias("torn"), *(w.alias(a) for w, a in zip(world, "xyz")), *(get(3 + k).alias(c) for k, c in enumerate(("intensity", "r", "g", "b"))))
    finite = F.greatest(*(F.when(F.isnan(a), float("inf")).otherwise(F.abs(a)) for a in "xyz")) < float("inf")
    points = points.withColumn("x", F.when(~F.col("torn") & finite, F.col("x")).otherwise(F.raise_error(F.concat("file", F.lit(": a place that is not finite, or a row that is no place")))))
    points = numbered(points.drop("torn")).withColumn("classification", F.lit(NAN))
    coloured = points.groupBy("file").agg((F.count_if(F.isnan("r")) == 0).alias("coloured"))
    yes = F.lit(True)
    points = points.join(points.groupBy("file").agg(*_tops()), "file")
    return _scaled(points.join(coloured, "file"), {"rgb": F.col("coloured"), "intensity": yes, "classification": F.lit(False)}, True, budget, stride, with_file)
