"""Rasters and drawings as Spark data sources: GeoTIFF sheets and DXF R12 drawings, written by all tasks and read back.

``write_raster`` writes a grid (i, j, z) as a folder of sheets of ``side`` by ``side`` cells, each a GeoTIFF of its own that knows
its place, so no task holds more than one sheet and viewers show the folder as one mosaic. ``spark.read.format("geotiff")``
reads the strips of such files, or of any single-band one of floats in strips, plain or deflated, in ranges of ``CELLS`` cells.

``write_drawing`` writes segments as drawings of at most ``ENTITIES`` lines each; ``spark.read.format("dxf")`` reads
the lines of drawings, a task a file, in constant memory.

Files have hidden names until the job commits. Paths are opened by ``open``, so they must be mounted on the executors. A null
z is a cell without a value, which is not written; a raster with cells that repeat is an error.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SIDE, STRIP = 1024, 64
#: Cells of one partition of a read; lines of one drawing.
CELLS, ENTITIES = 1 << 24, 1_000_000
RASTER = pa.schema([("sheet", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
LINES = pa.schema([("drawing", pa.string()), ("layer", pa.string()), *((f"{a}{k}", pa.float64()) for k in (0, 1) for a in "xyz")])
#: Fixed values of TIFF: sizes and codes of field types, tags.
SHORT, LONG, DOUBLE, ASCII = (3, "H"), (4, "I"), (12, "d"), (2, "s")
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
PLAIN, DEFLATE, FLOATS = 1, 8, 3


class RasterError(ValueError):
    """A raster that cannot be read or written."""


def local(path: str) -> str:
    return path.removeprefix("file://")


@dataclass
class Written(WriterCommitMessage):
    """(hidden path, shown path) of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FolderWriter(DataSourceArrowWriter):
    """Files of tasks under hidden names; the commit shows them, and only then removes what was there before."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.folder, self.overwrite = options, local(options["path"]), overwrite

    def opened(self, written: Written, name: str) -> BinaryIO:
        os.makedirs(self.folder, exist_ok=True)
        hidden = f"{self.folder}/.{uuid.uuid4().hex}"
        written.files.append((hidden, f"{self.folder}/{name}{self.suffix}"))
        return open(hidden, "wb")

    def commit(self, messages: list[Written | None]) -> None:
        made = [f for m in messages if m for f in m.files]
        shown = {name for _, name in made}
        if len(shown) < len(made):
            self.abort(messages)
            raise RasterError(f"{self.folder}: two tasks wrote one file; rows of a sheet must come to one task")
        before = {f"{self.folder}/{n}" for n in os.listdir(self.folder) if n.endswith(self.suffix) and n[0] != "."} if os.path.isdir(self.folder) else set()
        if not self.overwrite and before & shown:
            self.abort(messages)
            raise RasterError(f"{self.folder} holds {len(before & shown)} of these files already")
        os.makedirs(self.folder, exist_ok=True)  # an empty table is an empty folder
        for hidden, name in made:
            os.replace(hidden, name)
        if self.overwrite:
            for name in before - shown:
                os.remove(name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, _ in m.files if m else ():
                if os.path.exists(hidden):
                    os.remove(hidden)


# GeoTIFF --------------------------------------------------------------------------------------------------------------
def sheet_bytes(cells: np.ndarray, left: float, top: float, cell: float, epsg: int | None = None) -> bytes:
    """A GeoTIFF of rows from the top; NaN is no value."""
    height, width = cells.shape
    little = cells.astype(cells.dtype.newbyteorder("<"))
    strips = [zlib.compress(little[at : at + STRIP].tobytes(), 6) for at in range(0, height, STRIP)]
    keys = [(1024, 1), (1025, 1), (3072, epsg)] if epsg else [(1025, 1)]
    directory = [1, 1, 0, len(keys), *(v for key, value in keys for v in (key, 0, 1, value))]
    counts = [len(s) for s in strips]
    fields = [
        (WIDTH, LONG, [width]), (LENGTH, LONG, [height]), (BITS, SHORT, [cells.dtype.itemsize * 8]), (COMPRESSION, SHORT, [DEFLATE]), (PHOTOMETRIC, SHORT, [1]),
        (OFFSETS, LONG, [8 + sum(counts[:k]) for k in range(len(counts))]), (SAMPLES, SHORT, [1]), (ROWS, LONG, [STRIP]), (COUNTS, LONG, counts), (PLANAR, SHORT, [1]),
        (FORMAT, SHORT, [FLOATS]), (PIXEL_SCALE, DOUBLE, [cell, cell, 0.0]), (TIEPOINT, DOUBLE, [0.0, 0.0, 0.0, left, top, 0.0]), (GEO_KEYS, SHORT, directory), (NO_DATA, ASCII, b"nan\0"),
    ]
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    beyond, entries = at + 2 + 12 * len(fields) + 4, b""
    tail = b""
    for tag, (code, letter), values in fields:
        data = bytes(values) if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        if len(data) > 4:
            place = struct.pack("<I", beyond + len(tail))
            tail += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code, len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + tail


def raster_fields(path: str) -> tuple[str, dict[int, tuple]]:
    """Byte order and fields of a file's first image."""
    letters = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
    with open(path, "rb") as file:
        head = file.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise RasterError(f"{path}: no classic TIFF")
        file.seek(struct.unpack(order + "I", head[4:])[0])
        (n,) = struct.unpack(order + "H", file.read(2))
        out = {}
        for entry in [file.read(12) for _ in range(n)]:
            if len(entry) < 12:
                raise RasterError(f"{path}: its directory is cut off")
            tag, code, count = struct.unpack(order + "HHI", entry[:8])
            if code not in letters:
                continue
            form = f"{order}{count}{letters[code]}"
            data = entry[8:]
            if struct.calcsize(form) > 4:
                file.seek(struct.unpack(order + "I", data)[0])
                data = file.read(struct.calcsize(form))
            out[tag] = struct.unpack(form, data[: struct.calcsize(form)])
    return order, out


def checked(path: str) -> tuple[str, dict[int, tuple]]:
    order, found = raster_fields(path)
    one = {tag: found.get(tag, (default,))[0] for tag, default in ((SAMPLES, 1), (FORMAT, 1), (COMPRESSION, PLAIN), (BITS, 1), (317, 1))}
    if one[SAMPLES] != 1 or one[FORMAT] != FLOATS or one[COMPRESSION] not in (PLAIN, DEFLATE) or one[BITS] not in (32, 64) or one[317] != 1 or OFFSETS not in found:
        raise RasterError(f"{path}: not one band of floats in strips, plain or deflated")
    if PIXEL_SCALE not in found or TIEPOINT not in found:
        raise RasterError(f"{path}: its place is not stated")
    return order, found


@dataclass
class Strips(InputPartition):
    path: str
    first: int
    last: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = local(options["path"])

    def partitions(self) -> list[Strips]:
        out = []
        for path in listed(self.path, (".tif", ".tiff")):
            _, found = checked(path)
            strips, width, rows = len(found[OFFSETS]), found[WIDTH][0], found.get(ROWS, found[LENGTH])[0]
            per = max(1, CELLS // (width * rows))
            out += [Strips(path, at, min(at + per, strips)) for at in range(0, strips, per)]
        return out

    def read(self, part: Strips | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an empty folder
            return
        order, found = checked(part.path)
        width, height = found[WIDTH][0], found[LENGTH][0]
        rows = min(found.get(ROWS, (height,))[0], height)
        kind = np.dtype(f"{order}f{found[BITS][0] // 8}")
        scale, tie = found[PIXEL_SCALE], found[TIEPOINT]
        left, top = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        column, line = round(left / scale[0]), round(top / scale[1])
        missing = found.get(NO_DATA, (b"nan",))[0].rstrip(b"\0 ").decode()
        with open(part.path, "rb") as file:
            for k in range(part.first, part.last):
                file.seek(found[OFFSETS][k])
                data = file.read(found[COUNTS][k])
                data = zlib.decompress(data) if found[COMPRESSION][0] == DEFLATE else data
                z = np.frombuffer(data, kind, min(rows, height - k * rows) * width).astype(float)
                at = np.flatnonzero(~np.isnan(z) & (z != float(missing)))
                r, c = at // width + k * rows, at % width
                x, y = left + (c + 0.5) * scale[0], top - (r + 0.5) * scale[1]
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(part.path)] * len(at), pa.string()), pa.array(column + c), pa.array(line - 1 - r), pa.array(x), pa.array(y), pa.array(z[at])], schema=RASTER)


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(suffixes) and f[0] != ".")


class RasterWriter(FolderWriter):
    """Rows (si, sj, i, j, z) sorted by sheet; a sheet is written when the next one begins."""

    suffix = ".tif"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        written, held, cells = Written(), None, None
        side, cell = int(self.options.get("side", SIDE)), float(self.options["cell"])
        epsg, kind = self.options.get("epsg"), np.dtype(f"f{int(self.options.get('bits', 32)) // 8}")

        def end() -> None:
            if held is not None:
                with self.opened(written, f"sheet_{held[0]}_{held[1]}") as file:
                    file.write(sheet_bytes(cells, held[0] * side * cell, (held[1] + 1) * side * cell, cell, int(epsg) if epsg else None))
                    file.flush()
                    os.fsync(file.fileno())

        for batch in iterator:
            si, sj, i, j, z = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("si", "sj", "i", "j", "z"))
            starts = np.flatnonzero(np.r_[True, (si[1:] != si[:-1]) | (sj[1:] != sj[:-1])]) if len(si) else []
            for a, b in zip(starts, [*starts[1:], len(si)]):
                if held != (si[a], sj[a]):
                    end()
                    held, cells = (int(si[a]), int(sj[a])), np.full((side, side), np.nan, kind)
                row, column = (held[1] + 1) * side - 1 - j[a:b], i[a:b] - held[0] * side
                if len(np.unique(row * side + column)) < b - a or not np.isnan(cells[row, column]).all():
                    raise RasterError("cells repeat")
                cells[row, column] = z[a:b]
        end()
        return written


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "sheet string, i long, j long, x double, y double, z double"

    def reader(self, schema) -> RasterReader:
        return RasterReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def write_raster(grid: DataFrame, path: str, cell: float, side: int = SIDE, bits: int = 32, epsg: int | None = None) -> None:
    """A grid (i, j, z) as sheets, one shuffle by sheet; a sheet has at most ``side`` squared cells, so no task is hot."""
    sheets = [F.floor(F.col(a) / side).cast("long").alias(f"s{a}") for a in "ij"]
    rows = grid.where("z is not null and not isnan(z)").select(*sheets, F.col("i").cast("long"), F.col("j").cast("long"), F.col("z").cast("double"))
    rows = rows.repartition("si", "sj").sortWithinPartitions("si", "sj")
    register(grid.sparkSession)
    out = rows.write.format("geotiff").mode("overwrite").option("cell", repr(cell)).option("side", side).option("bits", bits)
    (out.option("epsg", epsg) if epsg else out).save(path)


# DXF ------------------------------------------------------------------------------------------------------------------
#: Fixed values of DXF R12: what is before and after the entities.
DXF_HEAD = b"0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1009\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"
DXF_END = b"0\nENDSEC\n0\nEOF\n"
ENDS = {"10": "x0", "20": "y0", "30": "z0", "11": "x1", "21": "y1", "31": "z1"}


class DrawingWriter(FolderWriter):
    suffix = ".dxf"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        written, file, n, most = Written(), None, 0, int(self.options.get("entities", ENTITIES))
        name = uuid.uuid4().hex
        for batch in iterator:
            for layer, *ends in zip(*(batch.column(c).to_pylist() for c in ("layer", *ENDS.values()))):
                if n % most == 0:
                    self.end(file)
                    file = self.opened(written, f"drawing_{name}_{n // most}")
                    file.write(DXF_HEAD)
                n += 1
                file.write("".join(["0\nLINE\n8\n", layer, "\n", *(f"{code}\n{v!r}\n" for code, v in zip(ENDS, ends))]).encode())
        self.end(file)
        return written

    @staticmethod
    def end(file: BinaryIO | None) -> None:
        if file:
            file.write(DXF_END)
            file.flush()
            os.fsync(file.fileno())
            file.close()


@dataclass
class Drawing(InputPartition):
    path: str


class DrawingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = local(options["path"])

    def partitions(self) -> list[Drawing]:
        return [Drawing(p) for p in listed(self.path, (".dxf",))]

    def read(self, part: Drawing | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an empty folder
            return
        name, rows = os.path.basename(part.path), []
        for row in drawn_lines(part.path):
            rows.append({"drawing": name, **row})
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, LINES)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, LINES)


def drawn_lines(path: str) -> Iterator[dict]:
    """Lines of the entities' section; a height that is not stated is 0."""
    section, line, awaits = None, None, False
    with open(path, encoding="utf-8", errors="replace") as file:
        for code in file:
            code, value = code.strip(), file.readline().rstrip("\r\n")
            if code == "0":
                if line is not None:
                    yield line
                line = {"layer": "0", "z0": 0.0, "z1": 0.0} if section == "ENTITIES" and value.strip() == "LINE" else None
                awaits = value.strip() == "SECTION"
                section = None if value.strip() == "ENDSEC" else section
            elif code == "2" and awaits:
                section, awaits = value.strip(), False
            elif line is not None and code in ENDS:
                line[ENDS[code]] = float(value)
            elif line is not None and code == "8":
                line["layer"] = value
    if line is not None:
        raise RasterError(f"{path}: a drawing that is cut off")


class Dxf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return "drawing string, layer string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"

    def reader(self, schema) -> DrawingReader:
        return DrawingReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DrawingWriter:
        return DrawingWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def write_drawing(segments: DataFrame, path: str, entities: int = ENTITIES) -> None:
    """Segments (x0, y0, x1, y1, and layer, z0, z1 where there are any) as drawings; those with a null or non-finite end are left out.

    Blanks and line ends of a layer's name become underscores; a null or empty name is layer 0.
    """
    given = set(segments.columns)
    ends = [(F.col(c) if c in given else F.lit(0.0)).cast("double").alias(c) for c in ENDS.values()]
    layer = F.regexp_replace(F.col("layer").cast("string"), r"\s", "_") if "layer" in given else F.lit("0")
    rows = segments.select(F.coalesce(F.nullif(layer, F.lit("")), F.lit("0")).alias("layer"), *ends)
    finite = " and ".join(f"{c} is not null and {c} - {c} = 0" for c in ENDS.values())
    register(segments.sparkSession)
    rows.where(finite).write.format("dxf").mode("overwrite").option("entities", entities).save(path)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(GeoTiff)
    spark.dataSource.register(Dxf)
