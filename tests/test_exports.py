"""Rasters and drawings: what is written is read back; odd files are errors."""

import random
import struct
from pathlib import Path

import numpy as np
import pytest

from lodestrata.sources import exports


def cells_of(spark, path):
    exports.register(spark)
    return {(r.i, r.j): r.z for r in spark.read.format("geotiff").load(str(path)).collect()}


@pytest.mark.parametrize("bits", [32, 64])
def test_a_raster_comes_back_over_sheets_of_both_signs(spark, tmp_path, bits):
    rnd = random.Random(3)
    cells = {(rnd.randint(-90, 140), rnd.randint(-70, 60)): rnd.uniform(-5, 9) for _ in range(3000)}
    rows = [(i, j, z) for (i, j), z in cells.items()] + [(500, 500, None), (501, 500, float("nan"))]
    grid = spark.createDataFrame(rows, "i long, j long, z double").repartition(3)
    exports.write_raster(grid, str(tmp_path / "r"), 0.5, side=32, bits=bits, epsg=32637)
    expected = {k: float(np.float32(z)) if bits == 32 else z for k, z in cells.items()}
    assert cells_of(spark, tmp_path / "r") == expected
    assert len(list(Path(tmp_path / "r").glob("*.tif"))) == len({(i // 32, j // 32) for i, j in cells})


def test_a_sheet_states_its_place(spark, tmp_path):
    exports.write_raster(spark.createDataFrame([(5, -3, 1.5)], "i long, j long, z double"), str(tmp_path / "r"), 0.25, side=16, epsg=3857)
    (file,) = Path(tmp_path / "r").glob("*.tif")
    order, fields = exports.raster_fields(str(file))
    assert order == "<" and fields[exports.WIDTH] == fields[exports.LENGTH] == (16,) and list(fields) == sorted(fields)
    assert fields[exports.TIEPOINT] == (0, 0, 0, 0.0, 0.0, 0) and fields[exports.PIXEL_SCALE][:2] == (0.25, 0.25)
    assert fields[exports.GEO_KEYS][-1] == 3857
    (row,) = spark.read.format("geotiff").load(str(file)).collect()
    assert (row.i, row.j, row.x, row.y, row.z) == (5, -3, 5.5 * 0.25, -2.5 * 0.25, 1.5)


def test_plain_strips_of_the_other_byte_order_and_ranges(spark, tmp_path, monkeypatch):
    """A file made apart: big-endian, no compression, a strip a row, a marked value for none."""
    z = np.arange(12, dtype=">f4").reshape(4, 3)
    offsets, counts = [8 + 12 * k for k in range(4)], [12] * 4
    fields = [(256, 3, [3]), (257, 3, [4]), (258, 3, [32]), (259, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 3, [1]), (279, 4, counts), (339, 3, [3]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 8.0, 0.0])]
    at, entries, tail = 8 + 48, b"", b""
    for tag, code, v in [*fields, (42113, 2, b"7\0")]:
        data = v if code == 2 else struct.pack(f">{len(v)}{dict([(3, 'H'), (4, 'I'), (12, 'd')])[code]}", *v)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", at + 2 + 12 * 12 + 4 + len(tail))
        tail += data if len(data) > 4 else b""
        entries += struct.pack(">HHI", tag, code, len(v)) + place
    path = tmp_path / "made.tif"
    path.write_bytes(b"MM\0*" + struct.pack(">I", at) + z.tobytes() + struct.pack(">H", 12) + entries + b"\0" * 4 + tail)
    monkeypatch.setattr(exports, "CELLS", 3)
    assert len(exports.RasterReader({"path": str(path)}).partitions()) == 4
    assert cells_of(spark, path) == {(5 + c, 3 - r): float(3 * r + c) for r in range(4) for c in range(3) if 3 * r + c != 7}


def test_rewriting_replaces_and_empty_grids_write_nothing(spark, tmp_path):
    one = spark.createDataFrame([(0, 0, 1.0), (99, 0, 2.0)], "i long, j long, z double")
    exports.write_raster(one, str(tmp_path / "r"), 1.0, side=8)
    exports.write_raster(one.where("i = 0"), str(tmp_path / "r"), 1.0, side=8)
    assert cells_of(spark, tmp_path / "r") == {(0, 0): 1.0}
    exports.write_raster(one.limit(0), str(tmp_path / "e"), 1.0)
    assert cells_of(spark, tmp_path / "e") == {}


def test_cells_that_repeat_are_an_error(spark, tmp_path):
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, z double")
    with pytest.raises(Exception, match="cells repeat"):
        exports.write_raster(twice, str(tmp_path / "r"), 1.0)


def test_files_that_are_no_rasters_are_errors(tmp_path):
    for name, content in (("a", b""), ("b", b"II+\0\0\0\0\0"), ("c", b"II*\0\x08\0\0\0\x05\0\x01")):
        path = tmp_path / f"{name}.tif"
        path.write_bytes(content)
        with pytest.raises((exports.RasterError, struct.error)):
            exports.RasterReader({"path": str(path)}).partitions()


def test_drawings_come_back_in_parts(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["walls", "a b", "", None]), *(rnd.uniform(-1e6, 1e6) for _ in range(4))) for _ in range(250)]
    lines = spark.createDataFrame(rows, "layer string, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    exports.write_drawing(lines.unionByName(spark.createDataFrame([("x", 1.0, None, 2.0, 3.0), ("x", float("inf"), 0.0, 2.0, 3.0)], lines.schema)).coalesce(1), str(tmp_path / "d"), 100)
    found = spark.read.format("dxf").load(str(tmp_path / "d")).collect()
    named = {"a b": "a_b", "": "0", None: "0"}
    assert sorted((r.layer, r.x0, r.y0, r.x1, r.y1) for r in found) == sorted((named.get(n, n), *v) for n, *v in rows)
    assert len({r.drawing for r in found}) == 3 and {r.z0 for r in found} == {0.0}
    assert all(p.read_bytes().endswith(b"0\nEOF\n") for p in Path(tmp_path / "d").glob("*.dxf"))


def test_lines_outside_the_entities_and_other_kinds_are_passed_over(tmp_path):
    path = tmp_path / "d.dxf"
    path.write_text("0\nSECTION\n2\nBLOCKS\n0\nLINE\n10\n9\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nCIRCLE\n8\nx\n10\n5\n0\nLINE\n 8\nL 1\n 10\n1\n 20\n2\n 11\n3\n 21\n4\n0\nENDSEC\n0\nEOF\n")
    assert list(exports.drawn_lines(str(path))) == [{"layer": "L 1", "x0": 1.0, "y0": 2.0, "z0": 0.0, "x1": 3.0, "y1": 4.0, "z1": 0.0}]
    path.write_text("0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nx\n10\n1")
    with pytest.raises(exports.RasterError, match="cut off"):
        list(exports.drawn_lines(str(path)))
