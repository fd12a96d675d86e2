"""Sinks of tables: reports, backups, and saves that keep versions and a journal."""

from __future__ import annotations

import datetime
import functools
import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 8
#: A version's journal entry, beside its rows; Spark passes over the name.
ENTRY = "_entry.json"


def report(df: DataFrame, path: str) -> None:
    """CSV with semicolons, a header and a byte-order mark at the start of each file."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"﻿{first}").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """All tables in one folder of JSON lines, a partition each."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("overwrite").partitionBy("table").text(path)


def restore(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    """One table of a backup with the schema of ``like``."""
    rows = spark.read.option("basePath", path).text(path).where(F.col("table") == name)
    return rows.select(F.from_json("value", like.schema).alias("r")).select("r.*")


def merged(stored: DataFrame, imported: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """Both tables' rows; of equal keys the newest, and of equally new ones the imported."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(imported.withColumn("__new", F.lit(1)))
    names = [c for c in stored.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(updated, "__new")).alias("r"))
    return best.select(*keys, "r.*").select(*stored.columns)


class StaleRevision(RuntimeError):
    """Another writer was first: the table's version is not the one that the writer read."""

    def __init__(self, path: str, expected: int, current: int) -> None:
        super().__init__(f"{path}: version {expected} was expected, {current} is there")
        self.expected, self.current = expected, current


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of the content that does not depend on their order; columns and types are part of it.

    The first 120 bits of each row's SHA-256, as JSON, are summed in two halves; any type that JSON can write will do.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}) if df.columns else F.lit(""), 256)
    halves = [F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)) for at in (1, 16)]
    n, *sums = df.agg(F.count("*"), *halves).first()
    return int(n), hashlib.sha256(f"{df.schema.simpleString()} {n} {sums[0]} {sums[1]}".encode()).hexdigest()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored versions, oldest first."""
    folder, files = _folder(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}")


def save(df: DataFrame, path: str, operation: str, keep: int = KEPT, expected: int | None = None) -> int:
    """Write a new version if the content differs from the last, with its journal entry, and keep the newest ``keep``.

    A version is a folder that holds the rows and the entry. It is written under a name of its own and put in place by one
    rename, which fails if that version is there: of two writers one wins, and the other gets :class:`StaleRevision`,
    as does one whose ``expected`` version is not the last. What a lost writer leaves behind is never read. ``path``/_journal
    is a copy of the entries, made good by the next save if a writer ends before it.
    """
    spark = df.sparkSession
    known = versions(spark, path)
    current = known[-1] if known else 0
    if expected is not None and expected != current:
        raise StaleRevision(path, expected, current)
    rows, after = fingerprint(df)
    before = entry(spark, path, current)["hash_after"] if known else None
    if before == after:
        return current
    staged = f"{path}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    note = {"ts": datetime.datetime.now(datetime.timezone.utc).isoformat(), "operation": operation, "version": current + 1, "rows": rows, "hash_before": before, "hash_after": after}
    _put(spark, f"{staged}/{ENTRY}", json.dumps(note))
    if not _renamed(spark, staged, f"{path}/version={current + 1}"):
        _delete(spark, staged)
        raise StaleRevision(path, current, versions(spark, path)[-1])
    sync_journal(spark, path)
    for old in versions(spark, path)[: -max(1, keep)]:
        _delete(spark, f"{path}/version={old}")
    return current + 1


def upsert(changes: DataFrame, path: str, keys: list[str], operation: str, expected: int | None = None, keep: int = KEPT) -> int:
    """A new version in which rows of ``changes`` stand for those with their keys; null is a key like others.

    ``expected`` is the version that the changes were made from; without it the last one counts, and a writer that comes
    between is still found. Empty changes and repeated keys are errors.
    """
    spark = changes.sparkSession
    total, distinct = changes.agg(F.count("*"), F.count_distinct(F.struct(*keys))).first()
    if not total:
        raise ValueError("no rows to save")
    if total != distinct:
        raise ValueError(f"{total - distinct} rows repeat the keys of others")
    known = versions(spark, path)
    current = known[-1] if known else 0
    if expected is not None and expected != current:
        raise StaleRevision(path, expected, current)
    if known:
        stored = spark.read.parquet(f"{path}/version={current}")
        same = functools.reduce(lambda a, b: a & b, (stored[k].eqNullSafe(changes[k]) for k in keys))
        changes = stored.join(changes, same, "left_anti").unionByName(changes, allowMissingColumns=True)
    return save(changes, path, operation, keep, expected=current)


def entry(spark: SparkSession, path: str, version: int) -> dict:
    """The journal entry that a version was saved with."""
    file, files = _folder(spark, f"{path}/version={version}/{ENTRY}")
    stream = files.open(file)  # Spark's readers pass over the name
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def sync_journal(spark: SparkSession, path: str) -> None:
    """Copy entries that the journal lacks; a copy is a folder named by the version, so doing it again changes nothing."""
    there = set(versions(spark, f"{path}/_journal"))
    for version in versions(spark, path):
        if version not in there:
            e = entry(spark, path, version)
            note = spark.createDataFrame([(e["ts"], e["operation"], e["rows"], e["hash_before"], e["hash_after"])], "ts string, operation string, rows long, hash_before string, hash_after string")
            note.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_journal/version={version}")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """All entries, also those of versions that are no longer kept."""
    sync_journal(spark, path)
    return spark.read.option("basePath", f"{path}/_journal").parquet(f"{path}/_journal")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    file, files = _folder(spark, path)
    out = files.create(file, False)
    out.write(bytearray(text.encode()))
    out.close()


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the folder got its new name: not if there is one of that name (rename without overwrite)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    kinds = gateway.new_array(getattr(fs, "Options$Rename"), 1)
    kinds[0] = getattr(fs, "Options$Rename").valueOf("NONE")
    context = fs.FileContext.getFileContext(_folder(spark, source)[1].getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(a), context.makeQualified(b), kinds)
    except Py4JJavaError as e:
        if _folder(spark, target)[1].exists(b):
            return False
        raise OSError(f"{target}: could not be put in place: {e.java_exception}") from e
    return True
