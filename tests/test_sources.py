"""Readers and writers against files that the tests build byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.expr import keeps
from lodestrata.sources import e57, formats, pointcloud

GOLD = [(500000.125, 6000000.25, 117.5), (500001.125, 6000001.25, 119.0), (500000.5, 6000000.875, 118.25)]
COLUMNS = {a: np.array([p[i] for p in GOLD]) for i, a in enumerate("xyz")} | {"r": np.array([0, 0.5, 1]), "g": np.array([1, 0.5, 0]), "b": np.array([0.0, 0, 1])}


def read(spark, path, **options):
    pointcloud.register(spark)
    return spark.read.format("pointcloud").options(**options).load(str(path)).orderBy("point_idx").collect()


def places(rows):
    return [(r.x, r.y, r.z) for r in rows]


@pytest.mark.parametrize("form", ["ply", "las", "xyz"])
def test_round_trip(spark, tmp_path, form):
    pointcloud.register(spark)
    rows = [(*map(float, p), *(float(COLUMNS[c][i]) for c in "rgb")) for i, p in enumerate(GOLD)]
    df = spark.createDataFrame(rows, "x double, y double, z double, r double, g double, b double").coalesce(1)
    df.write.format("pointcloud").option("form", form).mode("append").save(str(tmp_path / "out"))
    found = read(spark, tmp_path / "out")
    assert np.allclose(places(found), GOLD, atol=1e-3)
    assert np.allclose([[r.r, r.g, r.b] for r in found], np.column_stack([COLUMNS[c] for c in "rgb"]), atol=0.01)


def test_e57_round_trip(spark, tmp_path):
    e57.write(tmp_path / "a.e57", COLUMNS | {"intensity": np.array([0.1, 0.2, 0.3])}, "a & b")
    found = read(spark, tmp_path / "a.e57")
    assert places(found) == GOLD and np.allclose([r.intensity for r in found], [0.1, 0.2, 0.3])
    assert np.allclose([r.g for r in found], [1, 0.5, 0], atol=0.01)


def test_e57_many_packets_and_checksum(tmp_path):
    n = 20_000
    e57.write(tmp_path / "b.e57", {a: np.arange(n) * (k + 1.0) for k, a in enumerate("xyz")})
    got = next(e57.points(tmp_path / "b.e57"))
    assert len(got["x"]) == n and (got["z"] == np.arange(n) * 3.0).all()
    assert e57.crc32c(b"123456789") == 0xE3069283


def test_bit_packed_integers():
    node = e57.ET.fromstring('<v type="ScaledInteger" minimum="-3" maximum="9" scale="0.5" offset="1"/>')
    field, values = e57.Field(node), [-3, 0, 9, 4, -1]
    word = sum((v + 3) << (4 * i) for i, v in enumerate(values))
    assert field.decode(word.to_bytes(3, "little"), 5).tolist() == [v * 0.5 + 1 for v in values]


def test_sampling_agrees_with_the_expression(spark, tmp_path):
    n = 5_000
    (tmp_path / "s.las").write_bytes(formats.las_bytes({a: np.arange(n, dtype=float) for a in "xyz"}))
    found = [r.point_idx for r in read(spark, tmp_path / "s.las", stride=16, recordsPerPartition=700)]
    assert found == [r[0] for r in spark.range(n).where(keeps(F.col("id"), 16)).orderBy("id").collect()]
    first = np.flatnonzero(pointcloud.kept(np.arange(16 * 8), 16)) % 16
    assert first.tolist() == [0, 11, 5, 12, 9, 11, 6, 6]


def test_ply_ascii_and_mesh(spark, tmp_path):
    head = "ply\nformat ascii 1.0\ncomment crs=EPSG:1\nelement vertex 4\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\n"
    (tmp_path / "a.ply").write_text(head + "end_header\n1 2 3 255 0 0\n\n4 5 6 0 255 0\n7 8 9 0 0 255\n1 1 1 0 0 0")
    assert places(read(spark, tmp_path / "a.ply")) == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    (tmp_path / "m.ply").write_text(head + "element face 2\nproperty list uchar int vertex_indices\nend_header\n")
    with pytest.raises(formats.FormatError, match="mesh"):
        formats.ply_header(tmp_path / "m.ply")


def lzf_literals(data):
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


@pytest.mark.parametrize("form", ["ascii", "binary", "binary_compressed"])
def test_pcd(spark, tmp_path, form):
    head = f"VERSION .7\nFIELDS x y z rgb\nSIZE 8 8 8 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 3\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 3\nDATA {form}\n".encode()
    colors = [0xFF0000, 0x00FF00, 0x0000FF]
    if form == "ascii":
        body = "".join(f"{x} {y} {z} {c}\n" for (x, y, z), c in zip(GOLD, colors)).encode()
    elif form == "binary":
        body = b"".join(struct.pack("<3dI", *p, c) for p, c in zip(GOLD, colors))
    else:
        planar = b"".join(np.array([p[i] for p in GOLD]).tobytes() for i in range(3)) + np.array(colors, "<u4").tobytes()
        packed = lzf_literals(planar)
        body = struct.pack("<II", len(packed), len(planar)) + packed
    (tmp_path / "a.pcd").write_bytes(head + body)
    found = read(spark, tmp_path / "a.pcd")
    assert places(found) == GOLD and [(r.r, r.g, r.b) for r in found] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    (tmp_path / "b.pcd").write_bytes(head + body[:-9])
    with pytest.raises((formats.FormatError, ValueError)):
        list(formats.pcd_points(tmp_path / "b.pcd"))


def test_lzf_references_may_overlap():
    assert formats.lzf_decompress(bytes([0, 65, (7 << 5), 1, 0]), 11) == b"A" * 11
    with pytest.raises(formats.FormatError):
        formats.lzf_decompress(bytes([0, 65]), 2)


def test_text_clouds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Easting,Northing,Elevation,Class\n500000.125,6000000.25,117.5,2\nNaN-not,1,2,3\n500001.125,,6000001.25,119,300\n500000.5;6000000.875;118.25;2.5\n")
    found = read(spark, tmp_path / "a.csv")
    assert places(found) == GOLD and [r.classification for r in found] == [2, 255, 3]
    (tmp_path / "b.pts").write_text("2\n1 2 3 0.5 255 0 0\n4 5 6 1 0 255 0\n")
    found = read(spark, tmp_path / "b.pts")
    assert places(found) == [(1, 2, 3), (4, 5, 6)] and [r.r for r in found] == [1, 0]


def test_ptx(spark, tmp_path):
    scan = "2\n2\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n10 20 30 1\n1 2 3 0.5 255 0 0\n0 0 0 0.5 0 0 0\n4 5 6 0.25 0 255 0\n7 8 9 1 0 0 255\n"
    (tmp_path / "a.ptx").write_text(scan + scan)
    found = read(spark, tmp_path / "a.ptx")
    assert places(found) == [(11, 22, 33), (14, 25, 36), (17, 28, 39)] * 2 and [r.scan_id for r in found] == [0] * 3 + [1] * 3
    (tmp_path / "b.ptx").write_text(scan[:-20])
    with pytest.raises(formats.FormatError):
        list(formats.ptx_points(tmp_path / "b.ptx"))


def test_formats_without_a_decoder(tmp_path):
    (tmp_path / "a.laz").write_bytes(b"LASF")
    with pytest.raises(NotImplementedError, match="no decoder"):
        pointcloud.CloudReader({"path": str(tmp_path / "a.laz")}).partitions()


def test_column_names_and_layouts():
    names = ["longitude", "latitude", "altitude", "label", "reflectance"]
    assert formats.named_layout(names) == ["x", "y", "z", "classification", "intensity"]
    assert formats.text_layout("a.xyzrgb", 7) == ["x", "y", "z", "r", "g", "b", "classification"]
    assert formats.text_layout("a.pts", 5) == formats.text_layout("a.pts", 6) == ["x", "y", "z", "intensity"]
    assert formats.text_layout("a.xyz", 6) == ["x", "y", "z", "r", "g", "b"] and formats.text_layout("a.csv", 9)[-1] == "classification"


def test_intensity_is_scaled_by_the_whole_file(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "CHUNK", 2)
    for form, write in (("ascii", None), ("binary_little_endian", "<4f")):
        path = tmp_path / f"{form}.ply"
        head = f"ply\nformat {form} 1.0\nelement vertex 4\n" + "".join(f"property float {n}\n" for n in ("x", "y", "z", "intensity")) + "end_header\n"
        rows = [(0, 0, 0, 5), (0, 0, 0, 10), (0, 0, 0, 50), (0, 0, 0, 100)]
        body = b"".join(struct.pack(write, *r) for r in rows) if write else "".join(" ".join(map(str, r)) + "\n" for r in rows).encode()
        path.write_bytes(head.encode() + body)
        found = np.concatenate([c["intensity"] for c in formats.ply_points(str(path))])
        assert np.allclose(found, [0.05, 0.1, 0.5, 1.0])


def test_a_budget_holds_for_every_format(spark, tmp_path, monkeypatch):
    pointcloud.register(spark)
    n = 450_000
    (tmp_path / "t.xyz").write_text("".join(f"{i} 0 0\n" for i in range(n)))
    rows = spark.read.format("pointcloud").option("maxPoints", 1).load(str(tmp_path / "t.xyz"))
    found = sorted(r.point_idx for r in rows.select("point_idx").collect())
    assert len(found) == n // 3 and all(b // 3 == a for a, b in enumerate(found))
    xyz = {a: np.arange(n, dtype=float) for a in "xyz"}
    e57.write(str(tmp_path / "t.e57"), xyz)
    rows = spark.read.format("pointcloud").option("maxPoints", 1).load(str(tmp_path / "t.e57"))
    assert sorted(r.point_idx for r in rows.select("point_idx").collect()) == list(range(0, n, 3))
    assert e57.count(str(tmp_path / "t.e57")) == n and e57.stations(str(tmp_path / "t.e57"))[0]["count"] == n


def test_a_zero_quaternion_turns_nothing_and_unlimited_integers_are_refused():
    import xml.etree.ElementTree as ET

    pose = ET.fromstring("<pose><rotation>" + "".join(f"<{n}>0</{n}>" for n in "wxyz") + "</rotation></pose>")
    assert np.allclose(e57.rotation(pose), np.eye(3))
    turned = ET.fromstring("<pose><rotation><w>1</w><x>0</x><y>0</y><z>1</z></rotation></pose>")
    assert np.allclose(e57.rotation(turned), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    with pytest.raises(formats.FormatError):
        e57.Field(ET.fromstring('<rowIndex type="Integer"/>'))
