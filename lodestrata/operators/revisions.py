"""Chains of revisions: saves, undo and redo of a journal replayed with a cursor.

A save puts a revision behind the cursor and cuts off what could be redone; undo moves the cursor back, to before the first
revision at most, redo forward, to the newest at most. The fold needs two numbers a project, the cursor and the length of its branch,
so a task streams a project's sorted events in constant memory. What stands at a place of the branch is the last
save that was made there: a window over (project, place), which splits a project by its places. The end of a replay
is two tables, cursors and branches, from which the next one goes on: a long journal is replayed by prefixes that are checkpointed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SAVE, UNDO, REDO = "save", "undo", "redo"
FOLDED = "project long, event_id long, operation string, place long, top long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cursor and length of the branch behind each event; rows come sorted by project and event."""
    project, place, top, begun = None, 0, 0, False
    for batch in batches:
        places, tops = [], []
        for p, op, place0, top0 in zip(*(batch.column(c).to_pylist() for c in ("project", "operation", "place0", "top0"))):
            if p != project or not begun:
                project, place, top, begun = p, place0, top0, True
            if op == SAVE:
                place = top = place + 1
            elif op == UNDO:
                place = max(place - 1, 0)
            elif op == REDO:
                place = min(place + 1, top)
            places.append(place)
            tops.append(top)
        yield pa.RecordBatch.from_arrays(
            [batch.column("project"), batch.column("event_id"), batch.column("operation"), pa.array(places, pa.int64()), pa.array(tops, pa.int64())], ["project", "event_id", "operation", "place", "top"]
        )


def replay(journal: DataFrame, cursors: DataFrame | None = None, branches: DataFrame | None = None) -> DataFrame:
    """(project, event_id, operation, place, top, revision) behind each event of ``journal`` (project, event_id, operation).

    ``revision`` is the event that saved the current state, null before the first. Operations other than save, undo and
    redo change nothing. ``cursors`` (project, place, top) and ``branches`` (project, place, revision) are what
    :func:`state` gave for the events before; event ids rise within a project.
    """
    rows = journal.select(F.col("project").cast("long").alias("project"), F.col("event_id").cast("long").alias("event_id"), "operation")
    if cursors is None:
        rows = rows.withColumn("place0", F.lit(0)).withColumn("top0", F.lit(0))
    else:
        start = cursors.select("project", F.col("place").alias("place0"), F.col("top").alias("top0"))
        rows = rows.join(start, "project", "left").fillna(0, ["place0", "top0"])
    rows = rows.withColumns({"place0": F.col("place0").cast("long"), "top0": F.col("top0").cast("long")})
    # By a hash of its own: dealt by the project itself, the join's partitions would be taken, and a skewed join may split a project.
    folded = rows.repartition(F.xxhash64("project")).sortWithinPartitions("project", "event_id").mapInArrow(_fold, FOLDED)
    saved = F.when(F.col("operation") == SAVE, F.col("event_id"))
    here = Window.partitionBy("project", "place").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = folded.withColumn("own", saved)
    if branches is not None:
        older = branches.select("project", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("operation"), "place", F.lit(None).cast("long").alias("top"), F.col("revision").alias("own"))
        out = out.unionByName(older)
    out = out.withColumn("revision", F.last("own", ignorenulls=True).over(here)).where("event_id is not null")
    return out.select("project", "event_id", "operation", "place", "top", F.when(F.col("place") > 0, F.col("revision")).alias("revision"))


def state(replayed: DataFrame, cursors: DataFrame | None = None, branches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The cursors and branches behind a replay (from ``cursors`` and ``branches``, if it went on from them), materialised."""
    last = replayed.groupBy("project").agg(F.max_by(F.struct("place", "top"), "event_id").alias("s"))
    last = last.select("project", "s.place", "s.top")
    saves = replayed.where(F.col("operation") == SAVE).select("project", "place", "event_id", F.col("event_id").alias("revision"))
    if cursors is not None:
        last = last.unionByName(cursors.join(last, "project", "left_anti"))
        saves = saves.unionByName(branches.select("project", "place", F.lit(None).cast("long").alias("event_id"), "revision"))
    last = cut(last)
    newest = saves.groupBy("project", "place").agg(F.max_by("revision", F.coalesce("event_id", F.lit(-(2**63)))).alias("revision"))
    return last, cut(newest.join(last.select("project", "top"), "project").where("place <= top").select("project", "place", "revision"))
