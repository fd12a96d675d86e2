"""Headers and records of point-cloud files, as numpy columns; one function per format, no Spark in here.

Each reader takes a path and yields dictionaries of columns (x, y, z and what the file has of r, g, b, intensity,
classification, scan_id), in file order and in bounded chunks. Colours and intensities are scaled to 0..1.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

CHUNK = 200_000
Columns = dict[str, np.ndarray]


class FormatError(ValueError):
    """A file that is not what its extension says, or is cut short."""


# LAS ------------------------------------------------------------------------------------------------------------------
#: Fixed values of the format: point record types that hold colours, and where these begin.
LAS_COLOR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


def las_header(path: str) -> dict:
    with open(path, "rb") as file:
        head = file.read(375)
    if head[:4] != b"LASF" or len(head) < 227:
        raise FormatError(f"{path}: no LAS header")
    minor, start = head[25], struct.unpack_from("<I", head, 96)[0]
    kind, size = head[104] & 0x3F, struct.unpack_from("<H", head, 105)[0]
    count = struct.unpack_from("<I", head, 107)[0]
    if not count and minor >= 4 and len(head) >= 255:
        count = struct.unpack_from("<Q", head, 247)[0]
    return {
        "minor": minor, "start": start, "kind": kind, "size": size,
        "count": max(0, min(count, (os.path.getsize(path) - start) // max(size, 1))),
        "scale": struct.unpack_from("<3d", head, 131), "offset": struct.unpack_from("<3d", head, 155),
        "header": struct.unpack_from("<H", head, 94)[0], "records": struct.unpack_from("<I", head, 100)[0],
    }


def las_crs(path: str) -> str | None:
    """The coordinate system of the first projection record: text of record 2112, else 2111."""
    head = las_header(path)
    with open(path, "rb") as file:
        file.seek(head["header"])
        found: dict[int, str] = {}
        for _ in range(head["records"]):
            vlr = file.read(54)
            if len(vlr) < 54:
                break
            user, number, length = vlr[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", vlr, 18)
            body = file.read(length)
            if user == b"LASF_Projection" and number in (2111, 2112):
                found.setdefault(number, body.rstrip(b"\0").decode("utf-8", "replace"))
    return found.get(2112) or found.get(2111)


def las_points(path: str, first: int = 0, last: int | None = None) -> Iterator[Columns]:
    h = las_header(path)
    fields = [("xyz", "<3i4", 0), ("intensity", "<u2", 12), ("class", "u1", 15 if h["kind"] < 6 else 16)]
    if h["kind"] in LAS_COLOR_AT:
        fields.append(("rgb", "<3u2", LAS_COLOR_AT[h["kind"]]))
    kind = np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields], "offsets": [f[2] for f in fields], "itemsize": h["size"]})
    divisor = las_color_divisor(path, h, kind) if h["kind"] in LAS_COLOR_AT else 0
    last = h["count"] if last is None else min(last, h["count"])
    for at in range(first, last, CHUNK):
        rows = np.fromfile(path, kind, min(CHUNK, last - at), offset=h["start"] + at * h["size"])
        out = {a: rows["xyz"][:, i] * h["scale"][i] + h["offset"][i] for i, a in enumerate("xyz")}
        out["intensity"] = (rows["intensity"] / 65535).astype(np.float32)
        out["classification"] = (rows["class"] & 0x1F if h["kind"] < 6 else rows["class"]).astype(np.int16)
        if divisor:
            out |= {c: (rows["rgb"][:, i] / divisor).astype(np.float32) for i, c in enumerate("rgb")}
        yield out


def las_color_divisor(path: str, h: dict, kind: np.dtype) -> int:
    """255 or 65535 by the largest of about 4000 evenly spaced records; 0 if all of these are black."""
    rows = np.memmap(path, kind, "r", h["start"], (h["count"],)) if h["count"] else np.zeros(0, kind)
    top = int(rows["rgb"][:: max(1, h["count"] // 4000)].max(initial=0))
    return 0 if not top else 65535 if top > 255 else 255


# PLY ------------------------------------------------------------------------------------------------------------------
#: The format's names of scalar types.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}


def ply_header(path: str) -> dict:
    with open(path, "rb") as file:
        head = file.read(1 << 20)
    end = re.search(rb"end_header\r?\n", head)
    if not head.startswith(b"ply") or not end:
        raise FormatError(f"{path}: no PLY header")
    out: dict = {"start": end.end(), "comments": [], "elements": [], "form": ""}
    for line in head[: end.start()].decode("latin-1").splitlines()[1:]:
        word, _, rest = line.strip().partition(" ")
        if word in ("comment", "obj_info"):
            out["comments"].append(rest)
        elif word == "format":
            out["form"] = rest.split()[0]
        elif word == "element":
            name, count = rest.split()
            out["elements"].append((name, int(count), []))
        elif word == "property":
            out["elements"][-1][2].append(tuple(rest.split()))
    vertex = next((e for e in out["elements"] if e[0] == "vertex"), None)
    if vertex is None:
        raise FormatError(f"{path}: no vertices")
    if any(name == "face" and n for name, n, _ in out["elements"]):
        raise FormatError(f"{path}: a mesh, not a cloud")
    if any(p[0] == "list" for p in vertex[2]) or out["elements"][0][0] != "vertex":
        raise FormatError(f"{path}: vertices of variable length")
    return out | {"count": vertex[1], "fields": [(name, PLY_TYPES[kind]) for kind, name in vertex[2]]}


def ply_points(path: str, first: int = 0, last: int | None = None) -> Iterator[Columns]:
    h = ply_header(path)
    last = h["count"] if last is None else min(last, h["count"])
    kinds = dict(h["fields"])
    if h["form"] == "ascii":
        blocks = _ascii_blocks(path, h["start"], [n for n, _ in h["fields"]], first, last)
    else:
        order = ">" if h["form"] == "binary_big_endian" else "<"
        kind = np.dtype([(n, order + t) for n, t in h["fields"]])
        blocks = (np.fromfile(path, kind, min(CHUNK, last - at), offset=h["start"] + at * kind.itemsize) for at in range(first, last, CHUNK))
    top = ply_intensity_top(path, h)
    for rows in blocks:
        yield _named(lambda n: rows[n], kinds, top)


INTENSITY = ("intensity", "scalar_intensity", "scalar_Intensity", "i", "reflectance")


def ply_intensity_top(path: str, h: dict) -> float | None:
    """Largest intensity of the whole file where it is floating-point, so that all its parts are scaled alike."""
    kinds = dict(h["fields"])
    name = next((n for n in INTENSITY if n in kinds), None)
    if name is None or kinds[name][0] != "f" or not h["count"]:
        return None
    if h["form"] == "ascii":
        blocks = _ascii_blocks(path, h["start"], [n for n, _ in h["fields"]], 0, h["count"])
    else:
        order = ">" if h["form"] == "binary_big_endian" else "<"
        rows = np.memmap(path, np.dtype([(n, order + t) for n, t in h["fields"]]), "r", h["start"], (h["count"],))
        blocks = (rows[at : at + CHUNK] for at in range(0, h["count"], CHUNK))
    return float(max((np.nanmax(b[name], initial=0) for b in blocks), default=0))


def _ascii_blocks(path: str, start: int, names: list[str], first: int, last: int) -> Iterator[dict]:
    """Blank lines do not count; a last line without an end does not either."""
    with open(path, "rb") as file:
        file.seek(start)
        held, n = [], 0
        for line in file:
            if not line.endswith(b"\n") or not line.strip():
                continue
            if first <= n < last:
                held.append(line)
            n += 1
            if len(held) == CHUNK:
                yield _table(held, names)
                held = []
            if n >= last:
                break
    if held:
        yield _table(held, names)


def _table(lines: list[bytes], names: list[str]) -> dict:
    rows = np.loadtxt(lines, ndmin=2)
    return {n: rows[:, i] for i, n in enumerate(names)}


def _scaled(v: np.ndarray, kind: str) -> np.ndarray:
    """Colours and intensities by their type: integers by its range, floating-point as they are."""
    top = {"u1": 255, "i1": 127, "u2": 65535, "i2": 32767, "u4": 4294967295, "i4": 2147483647}.get(kind.lstrip("<>|="))
    return (v / top if top else v).astype(np.float32)


def _named(column, kinds: dict[str, str], top: float | None = None) -> Columns:
    """Columns by the names that vertex files use; ``top`` is the largest intensity, if not that of these rows."""
    out: Columns = {a: np.asarray(column(a), np.float64) for a in "xyz"}
    for c, names in {"r": ("red", "r", "diffuse_red"), "g": ("green", "g", "diffuse_green"), "b": ("blue", "b", "diffuse_blue")}.items():
        if name := next((n for n in names if n in kinds), None):
            out[c] = _scaled(np.asarray(column(name)), kinds[name])
    if name := next((n for n in INTENSITY if n in kinds), None):
        v = _scaled(np.asarray(column(name)), kinds[name])
        most = float(v.max(initial=0)) if top is None else top
        out["intensity"] = np.clip(v / most if most > 1.0001 else v, 0, 1).astype(np.float32)
    if name := next((n for n in ("classification", "scalar_Classification", "class", "label", "semantic") if n in kinds), None):
        v = np.nan_to_num(np.asarray(column(name), np.float64), nan=0, posinf=0, neginf=0)
        out["classification"] = np.clip(np.floor(v + 0.5), 0, 255).astype(np.int16)
    return out


# PCD ------------------------------------------------------------------------------------------------------------------
def pcd_header(path: str) -> dict:
    fields: dict[str, list[str]] = {}
    with open(path, "rb") as file:
        while line := file.readline():
            words = line.decode("latin-1").split("#")[0].split()
            if words:
                fields[words[0].upper()] = words[1:]
                if words[0].upper() == "DATA":
                    start = file.tell()
                    break
        else:
            raise FormatError(f"{path}: no PCD header")
    names = fields.get("FIELDS", [])
    sizes, types = [int(v) for v in fields.get("SIZE", [])], fields.get("TYPE", [])
    counts = [int(v) for v in fields.get("COUNT", ["1"] * len(names))]
    if not names or not len(names) == len(sizes) == len(types) == len(counts) or len(set(names)) < len(names):
        raise FormatError(f"{path}: fields, sizes, types and counts do not match")
    count = int(fields["POINTS"][0]) if "POINTS" in fields else int(fields["WIDTH"][0]) * int(fields["HEIGHT"][0])
    form = [(n, f"<{t.lower()}{s}", (c,) if c > 1 else ()) for n, t, s, c in zip(names, types, sizes, counts)]
    return {"start": start, "form": fields["DATA"][0].lower(), "count": count, "fields": form, "viewpoint": [float(v) for v in fields.get("VIEWPOINT", [])]}


def lzf_decompress(data: bytes, size: int) -> bytes:
    """LZF: runs of literals, and references that may overlap what they write; both lengths must be exact."""
    out, at = bytearray(), 0
    try:
        while at < len(data):
            control = data[at]
            at += 1
            if control < 32:
                if at + control + 1 > len(data):
                    raise FormatError("LZF: literals are cut short")
                out += data[at : at + control + 1]
                at += control + 1
                continue
            length = control >> 5
            if length == 7:
                length += data[at]
                at += 1
            back = ((control & 31) << 8) + data[at] + 1
            at += 1
            if back > len(out):
                raise FormatError("LZF: a reference before the start")
            for _ in range(length + 2):
                out.append(out[-back])
    except IndexError:
        raise FormatError("LZF: data are cut short") from None
    if len(out) != size:
        raise FormatError(f"LZF: {len(out)} bytes where {size} are due")
    return bytes(out)


def pcd_points(path: str, first: int = 0, last: int | None = None) -> Iterator[Columns]:
    h = pcd_header(path)
    kind = np.dtype(h["fields"])
    with open(path, "rb") as file:
        file.seek(h["start"])
        body = file.read()
    if h["form"] == "ascii":
        lines = [line for line in body.splitlines() if line.strip()]
        if len(lines) < h["count"]:
            raise FormatError(f"{path}: {len(lines)} of {h['count']} points")
        flat = np.loadtxt(lines[: h["count"]], ndmin=2)
        rows, at = {}, 0
        for n, t, shape in h["fields"]:
            rows[n] = flat[:, at]
            at += shape[0] if shape else 1
    elif h["form"] == "binary":
        if len(body) < h["count"] * kind.itemsize:
            raise FormatError(f"{path}: the points are cut short")
        rows = np.frombuffer(body, kind, h["count"])
    else:
        packed, size = struct.unpack_from("<II", body)
        if len(body) < 8 + packed or size != h["count"] * kind.itemsize:
            raise FormatError(f"{path}: the compressed points are cut short")
        data, rows, at = lzf_decompress(body[8 : 8 + packed], size), {}, 0
        for n, t, shape in h["fields"]:
            width = np.dtype(t).itemsize * (shape[0] if shape else 1)
            rows[n] = np.frombuffer(data, (t, shape) if shape else t, h["count"], at)
            at += width * h["count"]
    kinds = {n: t for n, t, _ in h["fields"]}
    columns = _named(lambda n: rows[n] if rows[n].ndim == 1 else rows[n][:, 0], kinds)
    packed = next((n for n in ("rgb", "rgba") if n in kinds), None)
    if packed:
        v = np.asarray(rows[packed])
        bits = v.astype(np.float32).view(np.uint32) if kinds[packed].endswith("f4") or (v.dtype.kind == "f" and (v % 1 != 0).any()) else v.astype(np.uint32)
        columns |= {c: ((bits >> s & 255) / 255).astype(np.float32) for c, s in (("r", 16), ("g", 8), ("b", 0))}
    good = np.isfinite(columns["x"]) & np.isfinite(columns["y"]) & np.isfinite(columns["z"])
    good[:first] = False
    if last is not None:
        good[last:] = False
    yield {k: v[good] for k, v in columns.items()} | {"__idx": np.flatnonzero(good), "__total": h["count"]}


# Text and PTX ---------------------------------------------------------------------------------------------------------
#: Names that columns of text clouds go by, first the one that counts most.
TEXT_NAMES = {
    "x": ("x", "easting", "east", "longitude", "lon"),
    "y": ("y", "northing", "north", "latitude", "lat"),
    "z": ("z", "elevation", "height", "altitude", "alt"),
    "intensity": ("intensity", "i", "reflectance", "return_intensity"),
    "r": ("red", "r"),
    "g": ("green", "g"),
    "b": ("blue", "b"),
    "classification": ("classification", "class", "label", "semantic"),
}
_XYZ, _RGB = ["x", "y", "z"], ["r", "g", "b"]
#: What files without names hold, in order, by extension and number of columns; the last entry is for more.
TEXT_LAYOUTS = {
    ".xyzrgb": {3: _XYZ, 6: _XYZ + _RGB, 7: [*_XYZ, *_RGB, "classification"]},
    ".pts": {3: _XYZ, 4: [*_XYZ, "intensity"], 7: [*_XYZ, "intensity", *_RGB], 8: [*_XYZ, "intensity", *_RGB, "classification"]},
    "": {
        3: _XYZ,
        4: [*_XYZ, "intensity"],
        5: [*_XYZ, "intensity", "classification"],
        6: _XYZ + _RGB,
        7: [*_XYZ, "intensity", *_RGB],
        8: [*_XYZ, "intensity", *_RGB, "classification"],
    },
}


def text_layout(path: str, n: int) -> list[str]:
    """Columns of a file without names, by its extension and number of columns."""
    layouts = TEXT_LAYOUTS.get(extension(path), TEXT_LAYOUTS[""])
    return layouts[max((k for k in layouts if k <= n), default=3)]


def named_layout(tokens: list[str]) -> list[str]:
    """Columns by their names; of two names for one column the one that counts more is it."""
    out = list(tokens)
    for column, names in TEXT_NAMES.items():
        if found := next((n for n in names if n in tokens), None):
            out[tokens.index(found)] = column
    return out


def text_tokens(line: str, csv: bool) -> list[str]:
    return [t for t in re.split(r"[,;\t]+" if csv else r"[\s,;]+", line.strip().lstrip("﻿")) if t.strip()]


def text_points(path: str, first: int = 0, last: int | None = None) -> Iterator[Columns]:
    csv = path.lower().endswith(".csv")
    layout: list[str] | None = None
    rows: list[list[float]] = []
    with open(path, encoding="utf-8-sig", errors="replace") as file:
        for line in file:
            if not re.match(r"\s*[-+]?(\d|\.\d)", line):
                text = line.strip().lower()
                names = text.partition("columns=")[2] if text.startswith("#") else text
                tokens = [t.strip() for t in text_tokens(names, csv)]
                known = named_layout(tokens)
                if layout is None and {"x", "y", "z"} <= set(known):
                    layout = known
                continue
            tokens = text_tokens(line, csv)
            if layout is None:
                if path.lower().endswith(".pts") and len(tokens) == 1:
                    continue  # the leading count
                layout = text_layout(path, len(tokens))
            rows.append([_number(t) for t in tokens[: len(layout)]] + [float("nan")] * (len(layout) - len(tokens)))
    table = np.array(rows, float).reshape(-1, len(layout or [0] * 3))
    columns = {n: table[:, i] for i, n in enumerate(layout or ["x", "y", "z"])}
    yield from _observed(columns, first, last)


def _number(token: str) -> float:
    try:
        return float(token)
    except ValueError:
        return float("nan")


def _observed(columns: Columns, first: int, last: int | None) -> Iterator[Columns]:
    """Scaled by what the whole file holds; rows without a finite place are left out, but have had their number."""
    out: Columns = {a: columns[a] for a in "xyz"}
    if {"r", "g", "b"} <= set(columns):
        top = max(np.nanmax(columns[c], initial=0) for c in "rgb")
        by = 65535 if top > 255 else 255 if top > 1.0001 else 1
        out |= {c: np.clip(columns[c] / by, 0, 1).astype(np.float32) for c in "rgb"}
    if "intensity" in columns:
        top = np.nanmax(columns["intensity"], initial=0)
        out["intensity"] = np.clip(columns["intensity"] / (top if top > 1.0001 else 1), 0, 1).astype(np.float32)
    if "classification" in columns:
        out["classification"] = np.clip(np.floor(np.nan_to_num(columns["classification"]) + 0.5), 0, 255).astype(np.int16)
    if "scan_id" in columns:
        out["scan_id"] = columns["scan_id"]
    good = np.isfinite(out["x"]) & np.isfinite(out["y"]) & np.isfinite(out["z"])
    good[:first] = False
    if last is not None:
        good[last:] = False
    yield {k: v[good] for k, v in out.items()} | {"__idx": np.flatnonzero(good), "__total": len(good)}


def ptx_points(path: str, first: int = 0, last: int | None = None) -> Iterator[Columns]:
    """Scans of a grid file in world coordinates; grid places without a return (0, 0, 0) have no number."""
    parts: list[Columns] = []
    with open(path, encoding="utf-8", errors="replace") as file:
        lines = (line.split() for line in file if line.strip())
        scan = 0
        for head in lines:
            try:
                cells = int(head[0]) * int(next(lines)[0])
                for _ in range(4):
                    next(lines)  # the scanner's place and axes
                m = np.array([[float(v) for v in next(lines)] for _ in range(4)])
                rows = np.array([[*map(float, row), *[float("nan")] * (7 - len(row))] for row in itertools.islice(lines, cells)]).reshape(-1, 7)
                if len(rows) < cells:
                    raise ValueError("too few places")
            except (StopIteration, ValueError, IndexError):
                raise FormatError(f"{path}: scan {scan} is cut short or is not a grid") from None
            rows = rows[(rows[:, :3] != 0).any(axis=1)]
            by_rows = bool((np.abs(m[:3, 3]) < 1e-8).all() and abs(m[3, 3] - 1) < 1e-8) or not bool((np.abs(m[3, :3]) < 1e-8).all() and abs(m[3, 3] - 1) < 1e-8)
            place = np.column_stack([rows[:, :3], np.ones(len(rows))]) @ (m if by_rows else m.T)
            if not np.isfinite(place).all():
                raise FormatError(f"{path}: scan {scan} has a place that is not finite")
            parts.append({"x": place[:, 0], "y": place[:, 1], "z": place[:, 2], "intensity": rows[:, 3], "r": rows[:, 4], "g": rows[:, 5], "b": rows[:, 6], "scan_id": np.full(len(rows), scan)})
            scan += 1
    joined = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in ("x", "y", "z", "intensity", "r", "g", "b", "scan_id")}
    if np.isnan(joined["r"]).any():
        joined = {k: v for k, v in joined.items() if k not in ("r", "g", "b")}
    yield from _observed(joined, first, last)


# Writers --------------------------------------------------------------------------------------------------------------
def ply_bytes_head(count: int, colored: bool, comments: list[str]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments), f"element vertex {count}", *(f"property double {a}" for a in "xyz")]
    lines += [f"property uchar {c}" for c in ("red", "green", "blue")] if colored else []
    return ("\n".join([*lines, "end_header"]) + "\n").encode()


def ply_rows(columns: Columns, colored: bool) -> bytes:
    kind = [(a, "<f8") for a in "xyz"] + ([(c, "u1") for c in "rgb"] if colored else [])
    rows = np.empty(len(columns["x"]), kind)
    for a in "xyz":
        rows[a] = columns[a]
    for c in "rgb" if colored else "":
        rows[c] = np.clip(np.floor(np.nan_to_num(columns[c]) * 255 + 0.5), 0, 255)
    return rows.tobytes()


def las_bytes(columns: Columns, scale: float = 0.001) -> bytes:
    """A LAS 1.4 file of point records 7."""
    n = len(columns["x"])
    low = [float(np.floor(columns[a].min())) if n else 0.0 for a in "xyz"]
    kind = np.dtype({"names": ["xyz", "i", "c", "rgb"], "formats": ["<3i4", "<u2", "u1", "<3u2"], "offsets": [0, 12, 16, 30], "itemsize": 36})
    rows = np.zeros(n, kind)
    for k, a in enumerate("xyz"):
        rows["xyz"][:, k] = np.rint((columns[a] - low[k]) / scale)
    rows["i"] = np.rint(np.nan_to_num(columns.get("intensity", np.zeros(n))) * 65535)
    rows["c"] = columns.get("classification", np.zeros(n))
    for k, c in enumerate("rgb"):
        rows["rgb"][:, k] = np.rint(np.nan_to_num(columns.get(c, np.zeros(n))) * 65535)
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 7
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<H", head, 105, 36)
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *low)
    box = [v for k, a in enumerate("xyz") for v in ((float(columns[a].max()), float(columns[a].min())) if n else (0.0, 0.0))]
    struct.pack_into("<6d", head, 179, *box)
    struct.pack_into("<Q", head, 247, n)
    return bytes(head) + rows.tobytes()


READERS = {".las": las_points, ".ply": ply_points, ".pcd": pcd_points, ".ptx": ptx_points, **{e: text_points for e in (".xyz", ".pts", ".txt", ".csv", ".xyzrgb")}}


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def split_points(path: str) -> int | None:
    """Number of records of a file whose records can be read from anywhere; None for one that is read from its start."""
    if extension(path) == ".las":
        return las_header(path)["count"]
    if extension(path) == ".ply" and (h := ply_header(path))["form"] != "ascii":
        return h["count"]
    return None


