"""Pairs of wall faces against all pairs in plain Python, and rooms that were planted."""

import math
import random
import re

import pytest

from lodestrata.operators import walls

SCHEMA = "id long, x0 double, y0 double, x1 double, y1 double"


def turned(rows, degrees, dx, dy):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(i, c * x0 - s * y0 + dx, s * x0 + c * y0 + dy, c * x1 - s * y1 + dx, s * x1 + c * y1 + dy) for i, x0, y0, x1, y1 in rows]


def room(thick):
    """Inner and outer faces of four walls around the origin, and a partition of one face."""
    inner, outer = 2.0, 2.0 + thick
    rows = []
    for k, r in ((0, inner), (4, outer)):
        rows += [(k, -r, -r, r, -r), (k + 1, r, -r, r, r), (k + 2, r, r, -r, r), (k + 3, -r, r, -r, -r)]
    return [*rows, (8, 0.5, -1.5, 0.5, 1.5)]


@pytest.mark.parametrize("degrees, dx, dy", [(0, 0, 0), (2, 500_000.25, 6_000_000.5), (47, -31.0, 12.0)])
def test_a_room_has_its_four_walls_wherever_it_lies(spark, degrees, dx, dy):
    faces = spark.createDataFrame(turned(room(0.3), degrees, dx, dy), SCHEMA)
    found = walls.walls(faces, 0.05, 0.6, 0.5).collect()
    assert sorted((r.a, r.b) for r in found) == [(0, 4), (1, 5), (2, 6), (3, 7)]
    for r in found:
        assert r.thickness == pytest.approx(0.3, abs=1e-6) and r.length == pytest.approx(4, abs=1e-6)
        assert math.hypot(r.x1 - r.x0, r.y1 - r.y0) == pytest.approx(4, abs=1e-6)
        assert math.hypot((r.x0 + r.x1) / 2 - dx, (r.y0 + r.y1) / 2 - dy) == pytest.approx(2.15, abs=1e-6)


def test_symmetric_walls_of_a_room_are_no_pair(spark):
    faces = spark.createDataFrame([r for r in room(0.3) if r[0] < 4], SCHEMA)
    assert walls.walls(faces, 0.05, 0.6, 0.5).count() == 0


def plain(rows, thinnest, thickest, overlap, degrees):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] >= b[0]:
                continue
            za, zb, o = complex(a[3] - a[1], a[4] - a[2]), complex(b[3] - b[1], b[4] - b[2]), complex(a[1], a[2])
            turn = abs((zb / za).imag) / max(abs((zb / za).real), 1e-300)
            if turn > math.tan(math.radians(degrees)):
                continue
            p, q = ((complex(*e) - o) / (za / abs(za)) for e in (b[1:3], b[3:5]))
            if p.real > q.real:
                p, q = q, p
            lo, hi = max(0, p.real), min(abs(za), q.real)
            if hi - lo < overlap:
                continue
            w = [p.imag + (q.imag - p.imag) * (s - p.real) / (q.real - p.real) for s in (lo, hi)]
            if w[0] * w[1] > 0 and all(thinnest <= abs(v) <= thickest for v in w):
                out[a[0], b[0]] = abs(sum(w)) / 2, hi - lo
    return out


def test_facing_equals_all_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        x, y, l, d = rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.uniform(0.2, 6), rnd.choice((0, 90, 180, 31)) + rnd.uniform(-4, 4)
        rows.append((i, x, y, x + l * math.cos(math.radians(d)), y + l * math.sin(math.radians(d))))
    found = walls.facing(spark.createDataFrame(rows, SCHEMA), 0.05, 0.7, 0.4).collect()
    expected = plain(rows, 0.05, 0.7, 0.4, 5.0)
    assert sorted((r.a, r.b) for r in found) == sorted(expected) and len(found) > 50
    for r in found:
        assert (r.thickness, r.length) == pytest.approx(expected[r.a, r.b], abs=1e-8)


def test_a_face_bounds_one_wall_and_ties_go_to_the_smaller_id(spark):
    rows = [(1, 0.0, 0.0, 3.0, 0.0), (2, 0.0, 0.25, 3.0, 0.25), (3, 3.0, -0.25, 0.0, -0.25), (4, 0.0, 0.625, 3.0, 0.625)]
    assert [(r.a, r.b) for r in walls.walls(spark.createDataFrame(rows, SCHEMA), 0.05, 0.6, 0.5).collect()] == [(1, 2)]


def test_odd_rows(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0.0), (2, None, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 3.0, 0.0), (4, 0.0, 0.0, 3.0, 0.0)]
    assert walls.walls(spark.createDataFrame(rows, SCHEMA), 0.05, 0.6, 0.5).count() == 0
    assert walls.walls(spark.createDataFrame([], SCHEMA), 0.05, 0.6, 0.5).count() == 0


def test_no_faces_go_through_the_driver(spark):
    faces = spark.createDataFrame([(i, float(i % 50), i / 40, i % 50 + 4.0, i / 40) for i in range(2000)], SCHEMA)
    found = walls.walls(faces, 0.037, 0.337, 0.777)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_faces_equal_all_pairs_far_from_the_origin(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        x, y, l, d = rnd.uniform(-9, 9) - 5e5, rnd.uniform(-9, 9) + 6e6, rnd.choice((0.5, 3, 9, 60)), rnd.choice((0, 90, 225, 31)) + rnd.uniform(-2, 2)
        rows.append((i, x, y, x + l * math.cos(math.radians(d)), y + l * math.sin(math.radians(d))))
    found = walls.facing(spark.createDataFrame(rows, SCHEMA), 0.05, 0.7, 0.4).collect()
    expected = plain(rows, 0.05, 0.7, 0.4, 5.0)
    assert sorted((r.a, r.b) for r in found) == sorted(expected) and len(found) > 20


def test_faces_are_in_few_cells_and_each_stage_is_compiled(spark, capsys):
    """The JVM interprets methods of over 8,000 bytes of code, a tenth as fast."""
    faces = spark.createDataFrame([(i, float(i % 50), i / 40, i % 50 + 2.5, i / 40) for i in range(2000)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        walls.walls(faces, 0.037, 0.337, 0.777).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        found = walls.facing(faces, 0.037, 0.337, 0.777)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 5 and max(sizes) < 8000
    assert plan.count("ReusedExchange") == 1  # the faces are dealt once
    near = faces.withColumn("length", walls._length())
    asked = near.select(walls._cells(0.777, walls.WIDTH * 1.114, 1.114).alias("c")).selectExpr("sum(size(c))").first()[0]
    assert asked < 4 * 2000  # narrow cells took nine times those that a face passes
