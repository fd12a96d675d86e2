"""Text clouds in ranges give the rows of the whole read in one task."""

import math
import random
import re

import pytest

from lodestrata.sources import formats, pointcloud, text_clouds


@pytest.fixture(params=["300b", "128m"])
def ranges(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    keep = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], request.param)
    spark.conf.set(keys[1], "1b")
    yield request.param
    for k, v in keep.items():
        spark.conf.set(k, v)


def same(ours, theirs):
    key = lambda r: (r["cloud"], r["point_idx"])
    ours, theirs = sorted(ours.collect(), key=key), sorted(theirs.collect(), key=key)
    assert [key(r) for r in ours] == [key(r) for r in theirs] and len(ours) > 0
    for a, b in zip(ours, theirs):
        for x, y in zip(a.asDict().values(), b.asDict().values()):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-6))), (a, b)


def whole(spark, path, **options):
    pointcloud.register(spark)
    return spark.read.format("pointcloud").options(**options).load(str(path))


def test_lists(spark, tmp_path, ranges):
    draw = random.Random(3)
    row = lambda k: " ".join(f"{draw.uniform(-1e3, 1e6):.4f}" for _ in range(k))
    (tmp_path / "a.csv").write_text("﻿Easting,Northing,Elevation,Class,Reflectance\n" + "".join(f"{row(3).replace(' ', ',')},{draw.randrange(400)},{draw.random() * 900:.2f}\n" + ("# note\n" if k % 7 == 0 else "") + ("NaN,1,2\n5;;6,x\n" if k % 9 == 0 else "") for k in range(60)))
    (tmp_path / "b.pts").write_text("60\n" + "".join(f"{row(3)} {draw.random():.3f} {draw.randrange(256)} 0 9\n" + ("7\n" if k == 30 else "") for k in range(60)))
    (tmp_path / "c.xyz").write_text("// free\n" + "".join(f"{row(3)}\r\n\r\n" for _ in range(50)))
    (tmp_path / "d.txt").write_text("# columns=y,x,z,red,green,blue\n" + "".join(f"{row(3)} {draw.random()} 0.5 1\n" for _ in range(50)) + "1 2")
    (tmp_path / "e.xyzrgb").write_text("".join(f"{row(3)} {draw.randrange(65536)} 7 8\n" for _ in range(20)))
    (tmp_path / "n.txt").write_text("no points here\n")
    same(text_clouds.read_lists(spark, str(tmp_path)), whole(spark, tmp_path))
    same(text_clouds.read_lists(spark, str(tmp_path), stride=4), whole(spark, tmp_path, stride=4))


def test_a_budget_counts_each_file(spark, tmp_path, monkeypatch):
    (tmp_path / "t.xyz").write_text("".join(f"{i} 0 0\n" for i in range(5000)))
    (tmp_path / "u.xyz").write_text("".join(f"{i} 0 0\n" for i in range(30)))
    monkeypatch.setattr(text_clouds, "LEAST_BUDGET", 100)
    monkeypatch.setattr(pointcloud, "LEAST_BUDGET", 100)
    got = text_clouds.read_lists(spark, str(tmp_path), budget=100)
    assert {r["cloud"]: r["count"] for r in got.groupBy("cloud").count().collect()} == {"t.xyz": 100, "u.xyz": 30}
    kept = pointcloud.kept(__import__("numpy").arange(5000), 50)
    assert sorted(r["point_idx"] for r in got.where("cloud = 't.xyz'").collect()) == kept.nonzero()[0].tolist()


def test_lines_of_lists_are_not_shuffled_and_their_stages_are_compiled(spark, tmp_path, capsys):
    """Only sums of ranges are; the JVM interprets methods of over 8,000 bytes of code, a tenth as fast."""
    (tmp_path / "t.xyz").write_text("".join(f"{i} 0 0 1 2 3\n" for i in range(500)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = text_clouds.read_lists(spark, str(tmp_path))
        found.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        found.explain()
        plan = capsys.readouterr().out
        assert found.count() == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 5 and max(sizes) < 8000
    assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\(.*(value|tokens)", plan)
    assert "row_number" not in plan and "SortAggregate" not in plan


def test_lists_of_odd_lines_in_many_ranges(spark, tmp_path, ranges):
    """Counts before and among the points, lines of one kind after the other, separators at both ends, numbers that are none."""
    lines = ["", "  77", "12", "", " ,1;2,3, 0.5 9 9 9;", "4 5 6", "1e3 -2.5E-1 +.5 x 1. 0x10 1d", "8", "# columns=x,y,z", "nan 1 2", "7 8 9", "inf 0 0"]
    (tmp_path / "a.pts").write_text("\n".join(lines + [f"{i} {i} {i} 0.25 1 2 3" for i in range(90)]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(["note", "# columns=z,class,y,x", *lines[4:], *lines]) + "\n")
    (tmp_path / "C.CSV").write_text("x,y,z\n1 , 2 ,3\n4 5,6,7\n8,9,10\n")
    same(text_clouds.read_lists(spark, str(tmp_path)), whole(spark, tmp_path))
    same(text_clouds.read_lists(spark, str(tmp_path), stride=3), whole(spark, tmp_path, stride=3))


def grid(draw, cols, rows, coloured, place, transposed=False):
    matrix = [[0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 1, 0], [*place, 1]]
    if transposed:
        matrix = [list(c) for c in zip(*matrix)]
    out = [str(cols), str(rows), "0 0 0", "1 0 0", "0 1 0", "0 0 1", *(" ".join(map(str, m)) for m in matrix)]
    for _ in range(cols * rows):
        p = "0 0 0" if draw.random() < 0.2 else " ".join(f"{draw.uniform(-9, 9):.3f}" for _ in range(3))
        out.append(f"{p} {draw.random():.3f}" + (f" {draw.randrange(256)} {draw.randrange(256)} 3" if coloured else ""))
    return "\n".join(out) + "\n"


def test_grids(spark, tmp_path, ranges):
    draw = random.Random(5)
    (tmp_path / "a.ptx").write_text(grid(draw, 7, 5, True, (10, 20, 30)) + grid(draw, 3, 9, True, (1, 2, 3), True) + "\n" + grid(draw, 2, 2, True, (0, 0, 0)))
    (tmp_path / "b.ptx").write_text(grid(draw, 4, 4, True, (5, 5, 5)) + grid(draw, 6, 6, False, (5, 5, 5)))
    same(text_clouds.read_grids(spark, str(tmp_path)), whole(spark, tmp_path))
    same(text_clouds.read_grids(spark, str(tmp_path), stride=3), whole(spark, tmp_path, stride=3))


def test_grids_that_are_cut_short(spark, tmp_path):
    text = grid(random.Random(1), 3, 3, False, (1, 1, 1))
    for name, bad in (("short", text[:-30]), ("long", text + "1 2 3 4\n"), ("none", "1 2 3\n"), ("half", text + "3\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.ptx").write_text(bad)
        with pytest.raises(formats.FormatError):
            text_clouds.read_grids(spark, str(tmp_path / name))
