"""Operators on small inputs whose results are known."""

import random
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import cleaning, clipping, documents, frames, linking, octree, spatial, surfaces
from lodestrata.operators.indexing import order_statistics, with_index

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def room(spark):
    """A floor, a wall, and a few points off both."""
    rnd = random.Random(1)
    rows = [(i, rnd.random() * 4, rnd.random() * 4, 0.0) for i in range(400)]
    rows += [(400 + i, rnd.random() * 4, 0.0, 0.2 + rnd.random() * 3) for i in range(250)]
    rows += [(650 + i, 20.0 + i, 30.0, 40.0 + 3 * i) for i in range(5)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


def test_planes_are_found_largest_first(room):
    found = cleaning.planes(room, 0.01, most=3, least=50)
    assert [p[4] for p in found] == sorted((p[4] for p in found), reverse=True)
    assert len(found) == 2 and found[0][4] >= 400 and found[1][4] >= 240
    assert abs(abs(found[0][2]) - 1) < 1e-6 and abs(abs(found[1][1]) - 1) < 1e-6
    assert cleaning.planes(room.limit(0), 0.01) == []


def test_cleaning_steps(room):
    far = {650, 651, 652, 653, 654}
    kept = {r.id for r in cleaning.clean(room, [], 1.0).collect()}
    assert not kept & far and len(kept) > 550
    assert kept == {r.id for r in cleaning.clean(room, [{"type": "denoise", "k": 6, "std": 1.0}], 1.0).collect()}
    thinned = cleaning.clean(room, [{"type": "downsample", "voxel": 1.0}], 1.0)
    assert thinned.count() < 100 and thinned.columns == room.columns
    auto = cleaning.clean(room, [{"type": "auto", "subsample": True, "voxel": 0.5}], 1.0)
    assert not {r.id for r in auto.collect()} & far
    whole = {r.id for r in cleaning.auto_clean(room, 0.3, k=6, std=3.0, least=1).collect()}
    assert not whole & far and len(whole) > 600
    assert cleaning.clean(room.limit(0), [], 1.0).count() == 0


def test_dbscan_marks_noise(spark):
    rows = [(i, float(i % 5) * 0.1, float(i // 5) * 0.1, 0.0) for i in range(25)] + [(100 + i, 5.0 + 0.1 * i, 0.0, 0.0) for i in range(6)] + [(200, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    found = {r.id: r.cluster for r in cleaning.dbscan(df, 0.15, 3).collect()}
    assert {found[i] for i in range(25)} == {0} and len({found[100 + i] for i in range(6)}) == 1 and found[200] is None


def test_components_that_do_not_settle_are_an_error(spark):
    cells = spark.range(40).selectExpr("id as c0", "0L as c1", "0L as c2")
    with pytest.raises(RuntimeError):
        spatial.components(cells, ["c0", "c1", "c2"], rounds=2)
    assert spatial.components(cells, ["c0", "c1", "c2"]).select("label").distinct().count() == 1


def test_index_and_order_statistics(spark):
    rnd = random.Random(2)
    values = [rnd.randint(0, 30) for _ in range(500)] + [7] * 500
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    found = [(r.point_idx, r.v) for r in with_index(df, ["v"]).orderBy("point_idx").collect()]
    assert [i for i, _ in found] == list(range(1000)) and [v for _, v in found] == sorted(values)
    row = order_statistics(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    assert (row.a, row.b, row.c) == tuple(sorted(values)[int(999 * p)] for p in (0.0, 0.37, 1.0))
    assert order_statistics(df.limit(0), "v", {"a": 0.5}).first().a is None


def test_numbers_need_not_keep_what_they_are_ordered_by(spark):
    df = spark.createDataFrame([(i * 7 % 100, str(i)) for i in range(100)], "v int, w string").repartition(5)
    found = with_index(df, ["v"], keep=["w"])
    assert found.columns == ["w", "point_idx"]
    assert {r.w: r.point_idx for r in found.collect()} == {str(i): i * 7 % 100 for i in range(100)}


def test_frames_go_there_and_back(room):
    a = F.lit("zup"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    b = F.lit("yup"), [F.lit(-4.0), F.lit(5.0), F.lit(6.0)]
    back = frames.map_frame(frames.map_frame(room, a, b), b, a)
    joined = back.join(room.selectExpr("id", "x as x0", "y as y0", "z as z0"), "id")
    assert joined.where("abs(x - x0) + abs(y - y0) + abs(z - z0) > 1e-9").count() == 0


def test_comments(spark):
    df = spark.createDataFrame([(["CRS_WKT_URI = A%2BB+C", "crs = EPSG: 4326"],), (["crs_wkt X"],), (["crs = epsg:25832"],), (["crs = local"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(frames.comment_crs(F.col("c"))).collect()] == ["A+B+C", "X", "EPSG:25832", None, None]


def test_polygon_against_a_walk_round_the_ring(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]
    rows = [(x + 0.5, y + 0.25) for x in range(-1, 11) for y in range(-1, 11)]
    df = spark.createDataFrame(rows, "x double, y double")

    def inside(x, y):
        n = 0
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                n += 1
        return n % 2 == 1

    found = {(r.x, r.y) for r in df.where(clipping.polygon(F.col("x"), F.col("y"), ring)).collect()}
    assert found == {p for p in rows if inside(*p)} and found


def test_contour_of_a_slope_is_a_line(spark):
    df = spark.createDataFrame([(float(i), float(j), float(i)) for i in range(6) for j in range(6)], "x double, y double, z double")
    found = surfaces.contours(surfaces.height_grid(df, 1.0), 2.5, 1.0).collect()
    assert {(r.level, r.x0, r.x1) for r in found} == {(2.5, 2.5, 2.5), (5.0, 5.0, 5.0)} or {r.level for r in found} == {2.5}
    assert all(abs(r.y0 - r.y1) == 1 for r in found)


def test_octree_is_written_and_read_by_node(spark, room, tmp_path):
    path = str(tmp_path / "octree")
    big = room.select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "x", "y", "z")
    octree.build(big, path, 1000, 4)
    sizes = {r.node: r["count"] for r in spark.read.parquet(path).groupBy("node").count().collect()}
    assert sum(sizes.values()) == big.count() and len(sizes) > 1
    for node, n in sizes.items():
        assert octree.read_node(spark, path, node).count() == n
        assert n <= 1000 or len(node) == 5
    assert octree.nodes(big.limit(0)).count() == 0


STEP = """ISO-10303-21;
DATA;
#1=IFCPROJECT('P0',#9,'Plant',$,$,$,$,(#8),#7);
#10=IFCBUILDINGSTOREY('S1',#9,'Level ''A''',$,$,#2,$,$,.ELEMENT.,0.);
#11=IFCSPACE('R1',#9,'101',$,$,#2,$,'Office',.ELEMENT.,.INTERNAL.,$);
#12=IFCSPACE('R2',#9,'102',$,$,#2,$,$,.ELEMENT.,.INTERNAL.,$);
#20=IFCWALL('W1',#9,'Wall, north',$,$,#2,#3,$);
#21=IFCDOOR('D1',#9,$,$,$,#2,#3,$,2.,1.);
#22=IFCSLAB('B1',#9,'Slab',$,$,#2,#3,$,.FLOOR.);
#30=IFCRELAGGREGATES('A1',#9,$,$,#10,(#11,#12));
#31=IFCRELCONTAINEDINSPATIALSTRUCTURE('C1',#9,$,$,(#20),#12);
#32=IFCRELCONTAINEDINSPATIALSTRUCTURE('C2',#9,$,$,(#21),#10);
ENDSEC;
"""


def test_a_step_file_is_read_and_linked(spark, tmp_path):
    (tmp_path / "m.ifc").write_text(STEP)
    model = linking.read_model(spark, str(tmp_path / "m.ifc"))
    found = {r.ref: (r.type, r.guid, r.name, r.container) for r in model.collect()}
    assert found[10] == ("IFCBUILDINGSTOREY", "S1", "Level 'A'", None)
    assert found[20] == ("IFCWALL", "W1", "Wall, north", 12) and found[21] == ("IFCDOOR", "D1", None, 10) and found[22][3] is None
    assert {r.ref: r.room for r in linking.rooms_of(model).collect()} == {20: 12, 21: 11, 22: None}
    stored = spark.createDataFrame([(5, "W1"), (6, "W1"), (7, ""), (8, None)], "id long, guid string")
    matched, created = linking.link(model.where("type rlike 'WALL|DOOR|SLAB'").drop("room"), stored)
    assert [(r.guid, r.stored_id) for r in matched.collect()] == [("W1", 6)] and sorted(r.guid for r in created.collect()) == ["B1", "D1"]


def test_documents_of_each_kind(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>One &amp; two</w:t></w:p><w:p/><w:p><w:t>x</w:t><w:tab/><w:t>&#233;</w:t></w:p></w:document>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>cell</t></si></sst>")
    (tmp_path / "c.txt").write_text("﻿plain é", encoding="utf-8")
    (tmp_path / "d.bin").write_bytes(b"a\0b")
    (tmp_path / "e.docx").write_bytes(b"no archive")
    (tmp_path / "f.csv").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in documents.read(spark, str(tmp_path)).collect()}
    assert found["a.docx"][0].split("\n")[0] == "One & two" and "x\té" in found["a.docx"][0]
    assert found["b.xlsx"] == ("cell", None) and found["c.txt"] == ("plain é", None) and "f.csv" not in found
    assert found["d.bin"] == (None, "binary") and found["e.docx"][0] is None and found["e.docx"][1]


def test_the_rest_works_without_the_optional_package(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "lodestrata", copy / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    for pipeline in (True, False):
        if pipeline:
            (copy / "corpus_pipeline.py").write_text("from lodestrata.llm import common\n")
        else:
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 115 and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(s) == set(q)"
        assert subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120).returncode == 0
