import datetime

from pyspark.sql import functions as F

from lodestrata.streaming import journal

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, folder):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder), journal.read_events(spark, folder, spark.read.parquet(folder).schema, 1)


def test_journal_and_drafts(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    journal.append_journal(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    journal.keep_drafts(stream, str(tmp_path / "drafts"), str(tmp_path / "c2")).awaitTermination()
    last = max(p.name for p in (tmp_path / "drafts").iterdir())
    found = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "drafts" / last)).collect()}
    assert found == {r[0]: r[1] for r in batch.groupBy("user_id").agg(F.max("event_id")).collect()}


def test_windows_equal_their_batch_form(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    for name, make in (("tumbling", journal.tumbling), ("sessions", lambda e: journal.sessions(e, "15 minutes"))):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).start()
        query.awaitTermination()
        found = set(map(tuple, spark.table(name).collect()))
        expected = set(map(tuple, make(batch).collect()))
        assert found == expected if name == "tumbling" else found <= expected and found


def test_drafts_are_state(spark, tmp_path):
    """Batches of files: replaced, cleared, late and expired drafts; a batch writes the keys that it changes."""
    day = datetime.datetime(2024, 1, 1)
    at = lambda d, h=0: day + datetime.timedelta(days=d, hours=h)
    batches = [
        [("a", 1, at(0), "saved", "a1"), ("b", 2, at(0), "saved", "b2"), ("a", 3, at(0, 1), "saved", "a3"), ("c", 4, at(0, 1), "saved", "c4"), ("e", 5, at(0, 1), "cleared", None)],
        [("b", 7, at(0, 2), "cleared", None), ("a", 2, at(0, 1), "saved", "late")],
        [("b", 6, at(0, 2), "saved", "late after clear"), ("c", 8, at(1), "saved", "c8"), ("c", 9, at(1), "saved", None)],
        [("b", 10, at(3), "saved", "b10")],
        [("d", 11, at(12), "saved", "d11")],
        [("d", 12, at(12, 1), "saved", "d12")],
    ]
    schema = "key string, event_id long, ts timestamp, operation string, payload string"
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", journal.STATE_STORE)
    written = []
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = journal.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
            journal.append_draft_changes(journal.draft_changes(stream, "10 minutes", 5.0), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
            log = spark.read.parquet(str(tmp_path / "log"))
            written.append(sorted((r.key, r.event_id, r.change) for r in log.collect()))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    new = [sorted(set(b) - set(a)) for a, b in zip([[]] + written, written)]
    assert new[0] == [("a", 3, "saved"), ("b", 2, "saved"), ("c", 4, "saved")]  # nothing to clear in e
    assert new[1] == [("b", 7, "cleared")] and new[2] == [("c", 9, "saved")] and new[3] == [("b", 10, "saved")]
    assert sorted(new[4] + new[5]) == [("a", 3, "expired"), ("b", 10, "expired"), ("c", 9, "expired"), ("d", 11, "saved"), ("d", 12, "saved")]
    assert [(r.key, r.payload) for r in journal.drafts(log).collect()] == [("d", "d12")]
