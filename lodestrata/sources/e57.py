"""E57 files: paged container, XML description, compressed vectors; a reader and a writer of one scan."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np

from .formats import Columns, FormatError

PAGE, BODY = 1024, 1020
NAMESPACE = "http://www.astm.org/COMMIT/E57/2010-e57-v1.0"
CRC_POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc >> 8) ^ _TABLE[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def _crc_row(i: int) -> int:
    for _ in range(8):
        i = (i >> 1) ^ (CRC_POLYNOMIAL if i & 1 else 0)
    return i


_TABLE = [_crc_row(i) for i in range(256)]


def logical(offset: int) -> int:
    """Place in the payload of a place in the file."""
    return offset // PAGE * BODY + min(offset % PAGE, BODY)


def physical(offset: int) -> int:
    return offset // BODY * PAGE + offset % BODY


def payload(path: str) -> tuple[bytes, bytes]:
    """Header, and the file without page checksums (these are not verified)."""
    with open(path, "rb") as file:
        data = file.read()
    if data[:8] != b"ASTM-E57" or len(data) < 48:
        raise FormatError(f"{path}: no E57 header")
    if struct.unpack_from("<Q", data, 40)[0] != PAGE:
        raise FormatError(f"{path}: pages are not of {PAGE} bytes")
    whole = np.frombuffer(data[: len(data) // PAGE * PAGE], np.uint8).reshape(-1, PAGE)[:, :BODY].tobytes()
    return data[:48], whole


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _child(node: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        node = next((c for c in node if _tag(c) == name), None) if node is not None else None
    return node


def _value(node: ET.Element | None, default: float = 0.0) -> float:
    return default if node is None else float((node.text or "").strip() or 0)


def description(path: str) -> tuple[ET.Element, bytes]:
    head, whole = payload(path)
    at, size = struct.unpack_from("<QQ", head, 24)
    return ET.fromstring(whole[logical(at) : logical(at) + size].decode("utf-8")), whole


class Field:
    """A column of a compressed vector: floating-point, or an integer in so many bits."""

    def __init__(self, node: ET.Element) -> None:
        self.name, kind = _tag(node), node.get("type")
        self.low, self.high = float(node.get("minimum", -(2**63))), float(node.get("maximum", 2**63 - 1))  # unlimited: 64 bits, refused below
        self.scale, self.offset, self.bits, self.float_ = 1.0, 0.0, 0, None
        if kind == "Float":
            self.float_ = "<f4" if node.get("precision") == "single" else "<f8"
            self.low, self.high = float(node.get("minimum", 0)), float(node.get("maximum", 0))
        elif kind in ("Integer", "ScaledInteger"):
            self.bits = math.ceil(math.log2(self.high - self.low + 1)) if self.high > self.low else 0
            if self.bits > 53:
                raise FormatError(f"{self.name}: {self.bits} bits")
            if kind == "ScaledInteger":
                self.scale, self.offset = float(node.get("scale", 1)), float(node.get("offset", 0))
        else:
            raise FormatError(f"{self.name}: type {kind}")

    def decode(self, data: bytes, count: int) -> np.ndarray:
        if self.float_:
            if len(data) < count * np.dtype(self.float_).itemsize:
                raise FormatError(f"{self.name}: data are cut short")
            return np.frombuffer(data, self.float_, count).astype(np.float64)
        if not self.bits:
            return np.full(count, self.low * self.scale + self.offset)
        if len(data) * 8 < count * self.bits:
            raise FormatError(f"{self.name}: data are cut short")
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * self.bits].reshape(count, self.bits)
        whole = bits @ (1 << np.arange(self.bits, dtype=np.int64))
        return (whole + self.low) * self.scale + self.offset


def columns_of(whole: bytes, section: int, fields: list[Field], count: int) -> dict[str, np.ndarray]:
    """Decoded columns of the compressed vector whose section begins at a place of the payload."""
    if whole[section] != 1:
        raise FormatError("no compressed vector where one should begin")
    length, data_at = struct.unpack_from("<QQ", whole, section + 8)
    at, end = logical(data_at), section + length
    streams: list[list[bytes]] = [[] for _ in fields]
    while at < end:
        kind, size = whole[at], struct.unpack_from("<H", whole, at + 2)[0] + 1
        if kind == 1:
            n = struct.unpack_from("<H", whole, at + 4)[0]
            sizes = struct.unpack_from(f"<{n}H", whole, at + 6)
            place = at + 6 + 2 * n
            for i, s in enumerate(sizes):
                streams[i].append(whole[place : place + s])
                place += s
        elif kind not in (0, 2):
            raise FormatError(f"a packet of type {kind}")
        at += size
    return {f.name: f.decode(b"".join(s), count) for f, s in zip(fields, streams)}


def rotation(pose: ET.Element | None) -> np.ndarray | None:
    """Matrix of a pose's quaternion, normalised; a zero one counts as of norm 1."""
    q = _child(pose, "rotation")
    if q is None:
        return None
    w, x, y, z = (_value(_child(q, n), d) for n, d in (("w", 1.0), ("x", 0.0), ("y", 0.0), ("z", 0.0)))
    n = math.sqrt(w * w + x * x + y * y + z * z) or 1.0
    w, x, y, z = w / n, x / n, y / n, z / n
    v, k = np.array([x, y, z]), np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) * (1 - 2 * (v @ v)) + 2 * np.outer(v, v) + 2 * w * k  # of a zero quaternion: the identity


def count(path: str) -> int:
    """Records of all scans."""
    scans = _child(description(path)[0], "data3D")
    vectors = (_child(node, "points") for node in ([] if scans is None else scans))
    return sum(int(v.get("recordCount")) for v in vectors if v is not None)


def stations(path: str) -> list[dict]:
    """Name, place and number of records of each scan, from the description alone."""
    scans, out = _child(description(path)[0], "data3D"), []
    for i, node in enumerate([] if scans is None else scans):
        name, move, vector = _child(node, "name"), _child(node, "pose", "translation"), _child(node, "points")
        place = {a: _value(_child(move, a)) for a in "xyz"}
        out.append({"name": (name.text or "").strip() if name is not None else f"scan {i}", **place, "count": int(vector.get("recordCount")) if vector is not None else 0})
    return out


def points(path: str, first: int = 0, last: int | None = None) -> Iterator[Columns]:
    """All scans in world coordinates; invalid and non-finite records are left out, but have had their number."""
    root, whole = description(path)
    at = 0
    scans = _child(root, "data3D")
    for scan, node in enumerate([] if scans is None else scans):
        vector = _child(node, "points")
        if vector is None:
            continue
        fields = [Field(f) for f in _child(vector, "prototype")]
        count = int(vector.get("recordCount"))
        c = columns_of(whole, logical(int(vector.get("fileOffset"))), fields, count)
        if "cartesianX" in c:
            xyz = np.column_stack([c["cartesianX"], c["cartesianY"], c["cartesianZ"]])
        else:
            r, az, el = c["sphericalRange"], c["sphericalAzimuth"], c["sphericalElevation"]
            xyz = np.column_stack([r * np.cos(el) * np.cos(az), r * np.cos(el) * np.sin(az), r * np.sin(el)])
        pose = _child(node, "pose")
        turn, move = rotation(pose), _child(pose, "translation")
        xyz = xyz if turn is None else xyz @ turn.T
        if move is not None:
            xyz = xyz + [_value(_child(move, a)) for a in "xyz"]
        out: Columns = {a: xyz[:, i] for i, a in enumerate("xyz")}
        by_name = {f.name: f for f in fields}
        for target, source, limits in (("r", "colorRed", "colorLimits"), ("g", "colorGreen", "colorLimits"), ("b", "colorBlue", "colorLimits"), ("intensity", "intensity", "intensityLimits")):
            if source in c:
                low = _value(_child(node, limits, f"{source}Minimum"), by_name[source].low)
                high = _value(_child(node, limits, f"{source}Maximum"), by_name[source].high)
                if not high > low:
                    low, high = 0.0, 1.0 if target == "intensity" else 255.0
                out[target] = ((c[source] - low) / (high - low)).astype(np.float32)
        good = np.isfinite(xyz).all(axis=1)
        for flag in ("cartesianInvalidState", "sphericalInvalidState"):
            good &= ~(c[flag] > 0) if flag in c else True
        index = at + np.flatnonzero(good)
        at += count
        inside = (index >= first) & (index < (last if last is not None else at + 1))
        yield {k: v[good][inside] for k, v in out.items()} | {"__idx": index[inside], "scan_id": np.full(int(inside.sum()), scan)}


def write(path: str, columns: Columns, name: str = "scan") -> None:
    """One scan without a pose: doubles, 8-bit colours and single intensities where there are any."""
    n = len(columns["x"])
    if not all(np.isfinite(columns[a]).all() for a in "xyz"):
        raise ValueError("a place that is not finite")
    parts = [(f"cartesian{a.upper()}", 'type="Float" precision="double"', columns[a].astype("<f8").tobytes(), 8) for a in "xyz"]
    for c, field in (("r", "colorRed"), ("g", "colorGreen"), ("b", "colorBlue")):
        if c in columns:
            data = np.clip(np.floor(columns[c] * 255 + 0.5), 0, 255).astype(np.uint8).tobytes()
            parts.append((field, 'type="Integer" minimum="0" maximum="255"', data, 1))
    if "intensity" in columns:
        parts.append(("intensity", 'type="Float" precision="single"', columns["intensity"].astype("<f4").tobytes(), 4))
    body = bytearray(48)
    section = len(body)
    body += bytes(32)
    data_at = len(body)
    step = 60_000 // sum(p[3] for p in parts)
    for at in range(0, n, step):
        pieces = [p[2][at * p[3] : (at + step) * p[3]] for p in parts]
        packet = bytearray(struct.pack(f"<BBHH{len(parts)}H", 1, 0, 0, len(parts), *map(len, pieces)) + b"".join(pieces))
        packet += bytes(-len(packet) % 4)
        struct.pack_into("<H", packet, 2, len(packet) - 1)
        body += packet
    struct.pack_into("<B7xQQQ", body, section, 1, len(body) - section, physical(data_at), 0)
    prototype = "".join(f"<{f} {kind}/>" for f, kind, _, _ in parts)
    limits = "" if "r" not in columns else '<colorLimits type="Structure">' + "".join(f'<color{c}{m} type="Integer">{v}</color{c}{m}>' for c in ("Red", "Green", "Blue") for m, v in (("Minimum", 0), ("Maximum", 255))) + "</colorLimits>"
    limits += '<intensityLimits type="Structure"><intensityMinimum type="Float">0</intensityMinimum><intensityMaximum type="Float">1</intensityMaximum></intensityLimits>' if "intensity" in columns else ""
    safe = name.replace("&", "&amp;").replace("<", "&lt;")
    xml = (
        f'<?xml version="1.0" encoding="UTF-8"?><e57Root type="Structure" xmlns="{NAMESPACE}"><formatName type="String">ASTM E57 3D Imaging Data File</formatName>'
        f'<data3D type="Vector" allowHeterogeneousChildren="1"><vectorChild type="Structure"><name type="String">{safe}</name>{limits}'
        f'<points type="CompressedVector" fileOffset="{physical(section)}" recordCount="{n}"><prototype type="Structure">{prototype}</prototype></points></vectorChild></data3D></e57Root>'
    ).encode()
    xml_at = len(body)
    body += xml
    body += bytes(-len(body) % BODY)
    struct.pack_into("<8sIIQQQQ", body, 0, b"ASTM-E57", 1, 0, len(body) // BODY * PAGE, physical(xml_at), len(xml), PAGE)
    with open(path, "wb") as file:
        for at in range(0, len(body), BODY):
            page = bytes(body[at : at + BODY])
            file.write(page + struct.pack(">I", crc32c(page)))
