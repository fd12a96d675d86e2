"""Specifications are checked before any job; their results equal plans written by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import cleaning, stages

SCHEMA = "id long, x double, y double, z double, classification int"


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.random(), rnd.random() * 0.2, i % 4) for i in range(400)] + [(900, 5.0, 5.0, 5.0, 1), (901, None, 1.0, 0.1, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize(
    "spec, said",
    [
        ([{"type": "denoyse"}], "stage 0 .denoyse.: no such stage"),
        ([{"type": "voxel", "sise": 0.1}], "unknown sise; it takes size"),
        ([{"type": "slab", "axis": "z", "at": 1}], "thickness is missing"),
        ([{"type": "slab", "axis": "w", "at": 1, "thickness": 1}], "axis must be"),
        ([{"type": "decimate", "step": 2.5}], "step must be int"),
        ([{"type": "decimate", "step": True}], "step must be int"),
        ([{"type": "voxel", "size": 0}], "size must be above 0"),
        ([{"type": "box", "centre": [0, 0], "half": [1, 1, 1]}], "centre must be"),
        ([{"type": "transform", "matrix": [1.0] * 16}], "matrix must be four rows"),
        ([{"type": "polygon", "ring": [[0, 0], [1, 1]]}], "three corners"),
        ([{"type": "range", "column": "height", "low": 1}], "no column height"),
        ([{"type": "select", "columns": ["x"]}, {"type": "voxel", "size": 1}], "stage 1 .voxel.: no column id, y, z"),
        ([{"type": "write_table", "path": "/nowhere"}, {"type": "voxel"}], "nothing comes behind a writer"),
        ([{"type": "read", "path": "/nowhere"}], "not beside a given table"),
        ([{"type": "range", "column": "x", "low": float("nan")}], "low must be float"),
        ([3], "an object with a type"),
        ([], "a list of stages"),
        ("{", "not JSON"),
    ],
)
def test_wrong_specifications_fail_before_any_job(spark, cloud, spec, said):
    spark.sparkContext.setJobGroup("specs", "")
    with pytest.raises(stages.SpecError, match=said):
        stages.run(spark, spec, cloud)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("specs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_specification_without_a_table_begins_with_a_reader():
    with pytest.raises(stages.SpecError, match="begin with a reader"):
        stages.check([{"type": "voxel"}])
    with pytest.raises(stages.SpecError, match="a reader comes first"):
        stages.check([{"type": "read", "path": "/a"}, {"type": "voxel"}, {"type": "read", "path": "/b"}])


def test_the_result_equals_a_plan_by_hand(spark, cloud):
    spec = [
        {"type": "range", "column": "z", "low": 0, "high": 0.15},
        {"type": "classes", "keep": [0, 1, 2]},
        {"type": "transform", "matrix": [0, -1, 0, 3, 1, 0, 0, 0, 0, 0, 1, 0.5, 0, 0, 0, 1]},
        {"type": "voxel", "size": 0.1},
        {"type": "statistical", "radius": 0.2, "k": 4, "std": 2},
        {"type": "ramp", "column": "z", "low": 0.5, "high": 0.7},
        {"type": "assign", "column": "kept", "value": 1},
    ]
    found = stages.run(spark, json.dumps(spec), cloud)
    hand = cloud.where("z between 0 and 0.15 and classification in (0, 1, 2)")
    hand = cleaning.thin(hand.select("id", (3 - F.col("y")).alias("x"), F.col("x").alias("y"), (F.col("z") + 0.5).alias("z"), "classification"), 0.1)
    hand = hand.join(cleaning.statistical_outliers(hand, 4, 2.0, 0.2), "id", "left_semi")
    assert found.columns == ["id", "x", "y", "z", "classification", "r", "g", "b", "kept"]
    assert sorted(map(tuple, found.select(*hand.columns).collect())) == sorted(map(tuple, hand.collect())) != []


def test_clips_and_neighbourhoods(spark, cloud):
    ids = {r.id for r in stages.run(spark, [{"type": "sphere", "centre": [5, 5, 5], "radius": 1}], cloud).collect()}
    assert ids == {900}
    spec = [{"type": "box", "centre": [0.5, 0.5, 0.1], "half": [1, 1, 1]}, {"type": "cluster", "radius": 0.2, "least": 3}, {"type": "normals", "k": 8, "radius": 0.3}, {"type": "decimate", "step": 4, "offset": 1}]
    rows = stages.run(spark, spec, cloud).collect()
    assert {r.id for r in rows} == {i for i in range(400) if i % 4 == 1} and {r.cluster for r in rows} == {0}
    assert all(r.nz is not None for r in rows)


def test_read_and_write(spark, cloud, tmp_path):
    first = [{"type": "range", "column": "x"}, {"type": "write_cloud", "path": str(tmp_path / "a")}, {"type": "write_table", "path": str(tmp_path / "t")}]
    assert stages.run(spark, first, cloud).count() == 401 == spark.read.parquet(str(tmp_path / "t")).count()
    second = [{"type": "read", "path": str(tmp_path / "a")}, {"type": "read", "path": str(tmp_path / "a")}, {"type": "write_raster", "path": str(tmp_path / "r"), "cell": 0.5}]
    found = stages.run(spark, second)
    assert sorted(r.id for r in found.select("id").collect()) == list(range(802))
    assert spark.read.format("geotiff").load(str(tmp_path / "r")).count() == len({(int(r.x // 0.5), int(r.y // 0.5)) for r in found.collect()})
