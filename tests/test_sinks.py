"""Reports, backups and versions."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import sinks


def test_report_has_a_mark_and_semicolons(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "id long, text string").coalesce(1)
    sinks.report(df, str(tmp_path / "r"))
    (file,) = Path(tmp_path / "r").glob("part-*")
    assert file.read_bytes().decode() == '﻿id;text\n1;"a;b"\n2;\n'


def test_backup_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, None), (2, "x\ny")], "id long, text string")
    b = spark.createDataFrame([(1, [1.5, None])], "id long, v array<double>")
    sinks.backup({"a": a, "b": b}, str(tmp_path / "b"))
    assert sorted(sinks.restore(spark, str(tmp_path / "b"), "a", a).collect()) == sorted(a.collect())
    assert sinks.restore(spark, str(tmp_path / "b"), "b", b).collect() == b.collect()


def test_merge_keeps_the_newest(spark):
    stored = spark.createDataFrame([(1, "old", 5), (2, "kept", 9), (3, "tie", 4)], "id long, text string, ts long")
    imported = spark.createDataFrame([(1, "new", 6), (2, "late", 8), (3, "tied", 4), (4, "added", 1)], "id long, text string, ts long")
    found = {r.id: r.text for r in sinks.merged(stored, imported, ["id"], "ts").collect()}
    assert found == {1: "new", 2: "kept", 3: "tied", 4: "added"}


def test_saves_keep_versions_and_a_journal(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(10)
    assert sinks.save(df, path, "create") == 1 and sinks.save(df.orderBy(F.desc("id")), path, "same") == 1
    for i in range(2, 6):
        assert sinks.save(spark.range(10 + i), path, f"edit {i}", keep=3) == i
    assert sinks.versions(spark, path) == [3, 4, 5] and sinks.latest(spark, path).count() == 15
    journal = [(r.operation, r.version, r.rows) for r in spark.read.parquet(f"{path}/_journal").orderBy("version").collect()]
    assert journal == [("create", 1, 10)] + [(f"edit {i}", i, 10 + i) for i in range(2, 6)]


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "id long, name string, v double")
    assert sinks.upsert(first, path, ["id"], "create", expected=0) == 1
    mine = spark.createDataFrame([(2, "mine", 9.0), (3, "new", 3.0), (None, "null", 7.0)], "id long, name string, v double")
    theirs = spark.createDataFrame([(1, "theirs")], "id long, name string")
    assert sinks.upsert(theirs, path, ["id"], "theirs", expected=1) == 2
    with pytest.raises(sinks.StaleRevision) as stale:
        sinks.upsert(mine, path, ["id"], "mine", expected=1)
    assert stale.value.current == 2
    # A writer that comes between the look and the rename.
    seen = sinks.versions
    monkeypatch.setattr(sinks, "versions", lambda s, p: [v for v in seen(s, p) if v < 2 or p.endswith("_journal")] if p == path else seen(s, p))
    with pytest.raises(sinks.StaleRevision):
        sinks.upsert(mine, path, ["id"], "mine")
    monkeypatch.setattr(sinks, "versions", seen)
    assert {r.id: (r.name, r.v) for r in sinks.latest(spark, path).collect()} == {1: ("theirs", None), 2: ("b", 2.0), None: ("n", 0.0)}
    assert sinks.upsert(mine, path, ["id"], "mine", expected=2) == 3
    assert {r.id: (r.name, r.v) for r in sinks.latest(spark, path).collect()} == {1: ("theirs", None), 2: ("mine", 9.0), 3: ("new", 3.0), None: ("null", 7.0)}
    assert [r.operation for r in sinks.journal(spark, path).orderBy("version").collect()] == ["create", "theirs", "mine"]
    assert not list(Path(path).glob("_writing-*"))


def test_an_entry_is_not_lost_with_its_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.save(spark.range(3), path, "first")
    with monkeypatch.context() as m:
        m.setattr(sinks, "sync_journal", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            sinks.save(spark.range(4), path, "second")
    assert sinks.latest(spark, path).count() == 4
    assert sinks.save(spark.range(5), path, "third", keep=1) == 3
    rows = sinks.journal(spark, path).orderBy("version").collect()
    assert [(r.version, r.operation, r.rows) for r in rows] == [(1, "first", 3), (2, "second", 4), (3, "third", 5)]
    assert all(a.hash_after == b.hash_before for a, b in zip(rows, rows[1:])) and sinks.versions(spark, path) == [3]


def test_content_is_told_by_columns_types_and_maps(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.sql("SELECT id, map('a', id) AS m, CAST(NULL AS string) AS s FROM range(3)")
    assert sinks.save(df, path, "maps") == 1 and sinks.save(df.repartition(5), path, "same") == 1
    assert sinks.save(df.drop("s"), path, "a column less") == 2 and sinks.save(df, path, "a column more") == 3
    assert sinks.save(df.withColumn("id", F.col("id").cast("int")), path, "a type") == 4
    with pytest.raises(ValueError, match="no rows"):
        sinks.upsert(df.limit(0), path, ["id"], "nothing")
    with pytest.raises(ValueError, match="repeat"):
        sinks.upsert(df.union(df), path, ["id"], "twice")
