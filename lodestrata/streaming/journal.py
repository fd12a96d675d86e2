"""Streaming twins of the journal: append, keyed drafts, event windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Events from Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_journal(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append operations to a Parquet journal by day, each exactly once."""
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and totals by window and type; rows later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start_ts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by user and session."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


def keep_drafts(events: DataFrame, target: str, checkpoint: str, key: str = "user_id", order: str = "event_id") -> StreamingQuery:
    """The latest draft of each key, as a table that every batch replaces: ``target``/batch=<n>; the newest one counts."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, f"{target}/batch={number - 1}"
        own = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if number:
            own = own.unionByName(spark.read.parquet(before))
            own = own.groupBy(key).agg(F.max_by(F.struct(*own.columns), order).alias("r")).select("r.*")
        own.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a draft's events say: a new state of it, or that it is done with.
SAVED, CLEARED, EXPIRED = "saved", "cleared", "expired"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key string, event_id long, ts timestamp, payload string, change string"
HELD = "event_id long, ts timestamp, cleared boolean"


class Drafts(StatefulProcessor):
    """The newest event of each key, by event id: a save replaces, a clear removes, and what is older than either does nothing.

    A cleared key keeps its event id, so that a late save does not bring it back. Keys without an event for ``days`` of event time
    are dropped from the state, with a change if there was a draft. State and work are those of the keys that change.
    """

    def __init__(self, days: float) -> None:
        self.keep_ms = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else None
        newest = None
        for batch in rows:
            row = batch.loc[batch["event_id"].idxmax()]
            if newest is None or row["event_id"] > newest["event_id"]:
                newest = row
        if newest is None or before is not None and newest["event_id"] <= before[0]:
            return
        cleared = newest["operation"] == CLEARED
        self.held.update((int(newest["event_id"]), newest["ts"].to_pydatetime(), bool(cleared)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(newest["ts"].timestamp() * 1000) + self.keep_ms)
        if not cleared or before is not None and not before[2]:
            yield self._change(key, newest["event_id"], newest["ts"], None if cleared else newest["payload"], CLEARED if cleared else SAVED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            event_id, ts, cleared = self.held.get()
            self.held.clear()
            if not cleared:
                yield self._change(key, event_id, pd.Timestamp(ts), None, EXPIRED)

    def close(self) -> None:
        pass

    @staticmethod
    def _change(key, event_id, ts, payload, change) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "event_id": [int(event_id)], "ts": [ts], "payload": [payload], "change": [change]})


def draft_changes(events: DataFrame, late: str = "10 minutes", days: float = 30.0) -> DataFrame:
    """Changes of drafts (key, event_id, ts, payload, change) for events (key, event_id, ts, operation, payload).

    The session needs the state store that :data:`STATE_STORE` names. One row a changed key and batch.
    """
    keyed = events.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(Drafts(days), CHANGE, "Update", "EventTime")


def append_draft_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Changes as a log of Parquet files, a folder a batch that a repeated batch writes anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drafts(log: DataFrame) -> DataFrame:
    """(key, event_id, ts, payload): the drafts that there are behind a log of changes."""
    last = log.groupBy("key").agg(F.max_by(F.struct("event_id", "ts", "payload", "change"), F.struct("event_id", F.col("change") != SAVED)).alias("r"))
    return last.where(F.col("r.change") == SAVED).select("key", "r.event_id", "r.ts", "r.payload")
