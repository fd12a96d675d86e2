"""Point-cloud files as a Spark data source.

``spark.read.format("pointcloud").load(path)`` reads a file or all cloud files of a folder. Binary LAS and PLY files are read in
ranges of ``recordsPerPartition`` records by as many tasks; other files by one task each. ``stride`` keeps one point per
window of so many, by the sampling hash (E57 and PTX: every so manieth), before rows leave the reader; ``maxPoints`` derives
the stride of each file from its records, which the header states or, in text files, the task counts (raised to 200,000
as the floor of a budget). Paths are read by ``open``, so they must be mounted on the executors. A text, PTX, PCD or E57 file
is held whole by its task, so it must fit the task's memory. Size and time of a file go with the plan: a file that has changed
when a task begins or ends its part is :class:`SourceChanged`.

``df.write.format("pointcloud").option("form", "ply" | "las" | "xyz")`` writes one file per task into a folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.expr import stride_for
from . import e57, formats

SCHEMA = "cloud string, scan_id int, point_idx long, x double, y double, z double, r float, g float, b float, intensity float, classification short"
ARROW = pa.schema(
    [("cloud", pa.string()), ("scan_id", pa.int32()), ("point_idx", pa.int64()), *((a, pa.float64()) for a in "xyz"), *((c, pa.float32()) for c in "rgb"), ("intensity", pa.float32()), ("classification", pa.int16())]
)
RECORDS = 1_000_000
LEAST_BUDGET = 200_000
READERS = formats.READERS | {".e57": e57.points}


def kept(index: np.ndarray, stride: int) -> np.ndarray:
    """The sampling hash in numpy: which global indices it keeps (see :mod:`lodestrata.functions.expr`)."""
    window = index // stride
    h = np.mod(window.astype(np.float64) * 2654435761.0, 4294967296.0).astype(np.int64)
    h ^= h >> 15
    h = np.mod(np.where(h >= 1 << 31, h - (1 << 32), h).astype(np.float64) * 2246822519.0, 4294967296.0).astype(np.int64)
    return index - window * stride == (h ^ (h >> 13)) % stride


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int | None
    stride: int
    budget: int | None = None
    stamp: tuple[int, int] | None = None


class SourceChanged(RuntimeError):
    """A file is not the one that the read was planned from."""


def stamp(path: str) -> tuple[int, int]:
    """Size and time of a file."""
    found = os.stat(path)
    return found.st_size, found.st_mtime_ns


def unchanged(part: Part) -> None:
    if part.stamp is not None and stamp(part.path) != part.stamp:
        raise SourceChanged(f"{part.path} changed while it was read")


def stride_of(count: int, budget: int) -> int:
    """One point of so many keeps a file within a budget, which is ``LEAST_BUDGET`` at least."""
    return stride_for(count, max(budget, LEAST_BUDGET))


#: Formats that are sampled by the plain remainder of the index.
BY_MODULO = (".e57", ".ptx")


def _count(path: str) -> int:
    """Records that the header of a file states, where its reader does not say."""
    return e57.count(path) if formats.extension(path) == ".e57" else formats.ply_header(path)["count"]


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if formats.extension(f) in READERS and not f.startswith("."))


class CloudReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Part]:
        per = int(self.options.get("recordsperpartition", RECORDS))
        stride, budget = int(self.options.get("stride", 1)), self.options.get("maxpoints")
        out = []
        for path in files(self.options["path"]):
            if formats.extension(path) not in READERS:
                raise NotImplementedError(f"{path}: there is no decoder for this format here (LAZ needs one that is not installed)")
            seen = stamp(path)
            count, own = formats.split_points(path), stride
            if budget and count is not None:
                own = stride_of(count, int(budget))
            if count is None:
                out.append(Part(path, 0, None, own, int(budget) if budget else None, seen))
            else:
                out += [Part(path, at, min(at + per, count), own, None, seen) for at in range(0, max(count, 1), per)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        at, stride = partition.first, None
        unchanged(partition)
        for columns in READERS[formats.extension(partition.path)](partition.path, partition.first, partition.last):
            n = len(columns["x"])
            index = columns.pop("__idx", np.arange(at, at + n))
            at += n
            total = columns.pop("__total", None)
            if partition.budget and stride is None:
                stride = stride_of(total if total is not None else _count(partition.path), partition.budget)
            step = stride or partition.stride
            if step > 1:
                chosen = index % step == 0 if formats.extension(partition.path) in BY_MODULO else kept(np.asarray(index, np.int64), step)
                index, columns = index[chosen], {k: v[chosen] for k, v in columns.items()}
            arrays = []
            for field in ARROW:
                if field.name == "cloud":
                    arrays.append(pa.array([os.path.basename(partition.path)] * len(index), pa.string()))
                elif field.name == "point_idx":
                    arrays.append(pa.array(index, pa.int64()))
                elif field.name == "scan_id":
                    arrays.append(pa.array(columns.get("scan_id", np.zeros(len(index))).astype(np.int32)))
                elif field.name in columns:
                    arrays.append(pa.array(np.asarray(columns[field.name]).astype(field.type.to_pandas_dtype()), field.type))
                else:
                    arrays.append(pa.nulls(len(index), field.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=ARROW)
        unchanged(partition)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class CloudWriter(DataSourceWriter):
    """One file per task, under a temporary name until the job commits; a lost task's file is never shown."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.form, self.overwrite = options["path"].removeprefix("file://"), options.get("form", "ply"), overwrite
        if self.form not in ("ply", "las", "xyz"):
            raise NotImplementedError(f"no writer for {self.form}")

    def write(self, iterator: Iterator) -> Written:
        rows = list(iterator)
        names = rows[0].asDict().keys() if rows else []
        columns = {n: np.array([r[n] for r in rows], float) for n in names if n in ("x", "y", "z", "r", "g", "b", "intensity", "classification") and any(r[n] is not None for r in rows)}
        columns = columns or {a: np.zeros(0) for a in "xyz"}
        colored = {"r", "g", "b"} <= set(columns)
        if self.form == "las":
            data = formats.las_bytes(columns)
        elif self.form == "ply":
            data = formats.ply_bytes_head(len(rows), colored, ["up=z"]) + formats.ply_rows(columns, colored)
        else:
            order = [n for n in ("x", "y", "z", "r", "g", "b", "intensity", "classification") if n in columns]
            data = "".join([f"# columns={','.join(order)}\n", *(" ".join(f"{columns[n][i]:.10g}" for n in order) + "\n" for i in range(len(rows)))]).encode()
        os.makedirs(self.folder, exist_ok=True)
        name = uuid.uuid4().hex
        message = Written(f"{self.folder}/.{name}", f"{self.folder}/part-{name}.{self.form}")
        with open(message.temporary, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        return message

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for old in files(self.folder):
                os.remove(old)
        for m in messages:
            if m:
                os.replace(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


class PointCloud(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CloudReader:
        return CloudReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        return CloudWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PointCloud)
