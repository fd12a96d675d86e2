"""Loops of sections, inward filling, normals and signs, revision chains, registration: against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import cleaning, clipping, frames, normals, revisions, surfaces


# Loops ----------------------------------------------------------------------------------------------------------------
def traced(cells):
    """Corners of all outlines by walking them, the occupied side to the left."""
    cells, steps = set(cells), [(1, 0), (0, 1), (-1, 0), (0, -1)]
    start = {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 1)}
    beyond = {0: (0, -1), 1: (1, 0), 2: (0, 1), 3: (-1, 0)}
    open_ = {(i, j, d) for i, j in cells for d in range(4) if (i + beyond[d][0], j + beyond[d][1]) not in cells}
    leaving = {}
    for i, j, d in open_:
        leaving.setdefault((i + start[d][0], j + start[d][1]), []).append((i, j, d))
    out = []
    while open_:
        first = min(open_)
        ring, e = [], first
        while True:
            open_.discard(e)
            end = (e[0] + start[e[2]][0] + steps[e[2]][0], e[1] + start[e[2]][1] + steps[e[2]][1])
            follow = min(leaving[end], key=lambda o: (e[2] - o[2] + 1) % 4)
            ring.append((e, end, follow[2] != e[2]))
            e = follow
            if e == first:
                break
        area = sum({1: end[0], 3: -end[0]}.get(e[2], 0) for e, end, _ in ring)
        out += [(k, *end, area, area > 0) for k, (_, end, turns) in enumerate(ring) if turns]
    return sorted(out)


def spiral(n):
    """One long winding wall: its outline has thousands of sides."""
    return [(x, y) for x in range(n) for y in range(n) if x % 2 == 0 or y == (n - 1 if x % 4 == 1 else 0)]


@pytest.mark.parametrize("name", ["random", "spiral", "touching", "ring", "one", "none"])
def test_loops_are_those_of_a_walk(spark, name):
    draw = random.Random(2)
    cells = {
        "random": [(i, j) for i in range(-15, 15) for j in range(-15, 15) if draw.random() < 0.55],
        "spiral": spiral(31),
        "touching": [(0, 0), (1, 1), (2, 0), (1, -1), (5, 5)],  # a hole that is closed by corners only
        "ring": [(i, j) for i in range(5) for j in range(5) if (i, j) != (2, 2)],
        "one": [(7, -9)] * 3,
        "none": [],
    }[name]
    df = spark.createDataFrame(cells, "i long, j long")
    got = surfaces.loops(df).collect()
    assert sorted((r["place"], r["x"], r["y"], r["area"], r["outer"]) for r in got) == traced(cells)
    assert sum(a for a in {r["loop"]: r["area"] for r in got}.values()) == len(set(cells))
    if name == "ring":
        assert sorted({r["area"] for r in got}) == [-1, 25]


def test_cells_too_far_out_are_an_error(spark):
    with pytest.raises(Exception, match="too far"):
        surfaces.loops(spark.createDataFrame([(1 << 40, 0)], "i long, j long")).collect()


# Filling --------------------------------------------------------------------------------------------------------------
def test_filling_inward(spark):
    draw = random.Random(4)
    known = {(i, j): (draw.randrange(256), draw.randrange(256), draw.randrange(256)) for i in range(20) for j in range(20) if draw.random() < 0.9 and not (4 <= i <= 14 and 3 <= j <= 16)}
    holes = {(i, j) for i in range(20) for j in range(20) if (i, j) not in known} | {(100, 100), (0, 0)}
    found, ring, k = {}, dict(known), 0
    while ring:
        k += 1
        around = lambda c: [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
        new = {}
        for c in holes - set(known) - set(found):
            if near := [ring[n] for n in around(c) if n in ring]:
                new[c] = tuple(math.floor(sum(v[m] for v in near) / len(near) + 0.5) for m in range(3))
        found |= {c: (k, *v) for c, v in new.items()}
        ring = new
    assert max(v[0] for v in found.values()) >= 5
    a = spark.createDataFrame([(*c, *v) for c, v in known.items()], "i long, j long, r int, g int, b int")
    b = spark.createDataFrame(sorted(holes), "i long, j long")
    got = {(r["i"], r["j"]): (r["ring"], r["r"], r["g"], r["b"]) for r in surfaces.fill_inward(a, b).collect()}
    assert {c: v[0] for c, v in got.items()} == {c: v[0] for c, v in found.items()} and got == found
    assert surfaces.fill_inward(a, b.limit(0)).count() == 0 and surfaces.fill_inward(a.limit(0), b).count() == 0


# Normals and signs ----------------------------------------------------------------------------------------------------
def test_least_direction_is_the_eigenvector(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, want = [], []
    for _ in range(60):
        m = rng.normal(size=(8, 3)) * [1, 2, 0.1 + rng.random()] @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
        c = np.cov(m.T, bias=True)
        rows.append([float(c[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))])
        want.append(np.linalg.eigh(c)[1][:, 0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, xx double, xy double, xz double, yy double, yz double, zz double")
    got = {r["id"]: [r["nx"], r["ny"], r["nz"]] for r in normals.least_direction(df).collect()}
    assert all(abs(abs(float(np.dot(got[i], want[i]))) - 1) < 1e-9 for i in range(60))
    odd = spark.createDataFrame([(0.0,) * 6, (1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "xx double, xy double, xz double, yy double, yz double, zz double")
    assert [r["nx"] for r in normals.least_direction(odd).collect()] == [None] * 3  # a heap, a ball, a line


@pytest.fixture(scope="module")
def tilted(spark):
    """A plane far from the origin, tilted; the height above it is the second part of each point of the other cloud."""
    draw, (a, b) = random.Random(6), (0.3, -0.2)
    size = math.sqrt(a * a + b * b + 1)
    n = (-a / size, -b / size, 1 / size)
    base = lambda u, v: (500000 + u, 6000000 + v, 100 + a * u + b * v)
    ref = [(i, *base(draw.random() * 3, draw.random() * 3)) for i in range(400)]
    heights = [draw.uniform(-0.2, 0.2) for _ in range(100)]
    own = []
    for i, h in enumerate(heights):
        p = base(0.3 + draw.random() * 2.4, 0.3 + draw.random() * 2.4)
        own.append((i, *(p[k] + h * n[k] for k in range(3))))
    kind = "id long, x double, y double, z double"
    return spark.createDataFrame(own, kind), spark.createDataFrame(ref, kind), heights


def test_signs_on_both_sides_of_a_plane(tilted):
    own, ref, heights = tilted
    up = {r["id"]: r["d"] for r in normals.signed_deviation(own, ref, 1.0, 8, 0.5).collect()}
    assert len(up) == 100 and all(up[i] * h > 0 for i, h in enumerate(heights) if abs(h) > 1e-6)
    below = {r["id"]: r["d"] for r in normals.signed_deviation(own, ref, 1.0, 8, 0.5, towards=(500000.0, 6000000.0, -900.0)).collect()}
    assert all(below[i] == -up[i] for i, h in enumerate(heights) if abs(h) > 1e-6)
    some = normals.signed_deviation(own, ref, 1e-6, 8, 0.5).collect()
    assert len(some) == 100 and any(r["d"] is None for r in some)
    assert 0 < normals.signed_deviation(own, ref, 1.0, 8, 0.5, voxel=1.0).count() < 40


def test_registration_brings_a_turned_cloud_back(spark):
    draw = random.Random(8)
    ref = [(i, draw.random() * 4, draw.random() * 3, draw.random() * 2) for i in range(300)]
    t, shift = 0.02, (0.02, -0.01, 0.015)
    moved = [(i, math.cos(t) * x - math.sin(t) * y + shift[0], math.sin(t) * x + math.cos(t) * y + shift[1], z + shift[2]) for i, x, y, z in ref]
    kind = "id long, x double, y double, z double"
    turn, move, rms = cleaning.register(spark.createDataFrame(moved, kind), spark.createDataFrame(ref, kind), 0.5)
    assert rms < 1e-6 and abs(turn[0][0] - math.cos(t)) < 1e-6 and abs(turn[0][1] - math.sin(t)) < 1e-6
    for (_, *p), (_, *q) in zip(moved, ref):
        assert all(abs(sum(turn[k][m] * p[m] for m in range(3)) + move[k] - q[k]) < 1e-5 for k in range(3))


# Caps that were ---------------------------------------------------------------------------------------------------------
def test_a_hundred_planes_protect_all_their_points(spark):
    points = spark.range(102).selectExpr("id", "cast(id as double) as x", "0.5D as y", "0.5D as z")
    planes = spark.range(100).selectExpr("1.0D as a", "0.0D as b", "0.0D as c", "cast(id as double) as d")
    assert sorted(r["id"] for r in clipping.on_planes(points, planes, 0.1).collect()) == [100, 101]
    assert clipping.on_planes(points, planes.limit(0), 0.1).count() == 102


def test_automatic_cleaning_that_does_not_settle_says_so(spark):
    draw = random.Random(1)
    cloud = spark.createDataFrame([(i, draw.random() * 3, draw.random() * 3, 0.0) for i in range(700)], "id long, x double, y double, z double")
    with pytest.raises(RuntimeError, match="settle"):
        cleaning.auto_clean(cloud, 0.1, k=6, std=0.5, least=1, rounds=2)


# Revisions ------------------------------------------------------------------------------------------------------------
def stacked(events):
    out, held = [], {}
    for project, event, op in sorted(events, key=lambda e: e[1]):
        branch, place = held.get(project, ([], 0))
        if op == "save":
            branch, place = [*branch[:place], event], place + 1
        elif op == "undo":
            place = max(place - 1, 0)
        elif op == "redo":
            place = min(place + 1, len(branch))
        held[project] = branch, place
        out.append((project, event, op, place, len(branch), branch[place - 1] if place else None))
    return sorted(out, key=lambda r: r[1])


def test_replay_is_that_of_a_stack_from_any_prefix(spark):
    draw = random.Random(5)
    events = [(0 if draw.random() < 0.4 else draw.randrange(1, 20), i, draw.choices(["save", "undo", "redo", "open"], [4, 4, 3, 1])[0]) for i in range(4000)]
    df = spark.createDataFrame(events, "project long, event_id long, operation string")
    want = stacked(events)
    rows = lambda d: sorted(map(tuple, d.collect()), key=lambda r: r[1])
    assert rows(revisions.replay(df)) == want
    held, got = (None, None), []
    for low, high in ((0, 900), (900, 901), (901, 2500), (2500, 4000)):
        part = revisions.replay(df.where(F.col("event_id").between(low, high - 1)), *held)
        got += rows(part)
        held = revisions.state(part, *held)
    assert got == want
    assert revisions.replay(df.limit(0)).count() == 0


def test_a_project_that_a_skewed_join_splits_is_still_one_chain(spark):
    odd = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k, None) for k in odd}
    project = F.when(F.col("event_id") % 20 == 0, F.col("event_id") % 7).otherwise(100)
    operation = F.element_at(F.array(*map(F.lit, ("save", "save", "redo", "undo"))), (F.xxhash64("event_id") % 2 + F.col("event_id") % 2 + 2).cast("int"))
    df = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("event_id")).select(project.alias("project"), "event_id", operation.alias("operation"))
    want = {tuple(r) for r in revisions.replay(df).collect()}
    held = revisions.state(revisions.replay(df.where("event_id < 20000")))
    try:
        for k, v in odd.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in revisions.replay(df.where("event_id >= 20000"), *held).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {r for r in want if r[1] >= 20000}


# Comments ---------------------------------------------------------------------------------------------------------------
def test_what_comments_set(spark):
    rows = [
        (["vendor_crs_wkt_uri = A%2BB+C%20", "crs = EPSG: 25832"], "A+B+C", None, None),
        (["made by hand", "CRS_WKT PROJCS[x = 1]"], "PROJCS[x = 1]", None, None),
        (["crs_wkt=", "crs=EPSG: 4326 ", "units = m"], "EPSG:4326", "m", None),
        (["crs = 4326", "crs: EPSG:4326", "vendor_Units=  mm ", "up : z"], None, "mm", "z"),
        (["crs_wkt_uri = %zz"], "%zz", None, None),
        (["scanned on safari", "UP = Y"], None, None, "y"),
        (["scanned on safari"], None, None, "z"),
        (["the z-up frame"], None, None, "z"),
        (["up=yes", "setup=y"], None, None, None),
        ([], None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id long, c array<string>")
    got = df.select("id", frames.comment_crs(F.col("c")), frames.comment_units(F.col("c")), frames.comment_up(F.col("c"))).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]
