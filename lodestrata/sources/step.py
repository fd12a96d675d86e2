"""STEP text (ISO 10303-21) by entity.

A record ends at a semicolon outside of strings and comments, wherever lines end. Files are read by Spark's text source, split at
every semicolon, in ranges as large as its partitions; what a range begins in (outside, in a string, in a comment) depends on all
before it. Each range is therefore first folded into a map from the state it begins in to the state it ends in; maps are
composed along the ranges of a file, one row a range; then each range is cut into records from its own state. Only the pieces that cross
a range's border, at most two a range, are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: States: outside, in a string, in a comment. Fixed values of the format.
OUTSIDE, STRING, COMMENT = 0, 1, 2
ENDS = {STRING: "'", COMMENT: "*/"}
OPENS = re.compile(r"'|/\*")
COMMENTS = re.compile(r"('[^']*')|/\*.*?\*/", re.S)
PIECE = "file string, block long, seq long, piece string, open boolean, ends boolean"


def after(text: str, state: int) -> int:
    """The state behind a text that begins in ``state``. A doubled quote leaves a string and enters it again."""
    at = 0
    while True:
        if state != OUTSIDE:
            end = text.find(ENDS[state], at)
            if end < 0:
                return state
            at, state = end + len(ENDS[state]), OUTSIDE
        found = OPENS.search(text, at)
        if found is None:
            return OUTSIDE
        at, state = found.end(), STRING if found.group() == "'" else COMMENT


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: the state it ends in for each that it may begin in."""
    key, ends = None, [0, 1, 2]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": pa.array([key[1]], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int32()))})

    for batch in batches:
        for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != key:
                if key:
                    yield row()
                key, ends = (file, block), [0, 1, 2]
            ends = [after(text, s) for s in ends]
    if key:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of records: ``open`` if it continues one of the range before, ``ends`` if the record ends with it.

    Rows come sorted by file, range and place. Every text is followed by a semicolon, but for the last one of a file.
    """
    key, state, held, first, at = None, OUTSIDE, [], True, 0
    for batch in batches:
        out = {n: [] for n in ("file", "block", "seq", "piece", "open", "ends")}

        def put(key: tuple, at: int, piece: str, first: bool, ends: bool, out: dict = out) -> None:
            for name, value in zip(out, (*key, at, piece, first, ends)):
                out[name].append(value)

        for file, block, begins, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "begins", "value"))):
            if (file, block) != key:
                if held:
                    put(key, at, ";".join(held), first, False)
                # A range begins behind a semicolon: inside a record only if that was in a string or a comment.
                key, state, held, first, at = (file, block), begins, [], begins != OUTSIDE, 0
            held.append(text)
            state = after(text, state)
            if state == OUTSIDE:
                put(key, at, ";".join(held), first, True)
                held, first, at = [], False, at + 1
        yield pa.RecordBatch.from_pydict(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("open", pa.bool_()), ("ends", pa.bool_())]))
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "seq", "piece", "open", "ends"), (*key, at, ";".join(held), first, False)))])


def _without_comments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [COMMENTS.sub(lambda m: m.group(1) or " ", t) if "/*" in t else t for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("seq"), pa.array(texts, pa.string())], ["file", "block", "seq", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text): the records of STEP files, without their semicolon and without comments, in order of (block, seq)."""
    raw = spark.read.option("lineSep", ";").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    folded = raw.mapInArrow(_folded, "file string, block long, ends array<int>")
    ranges = folded.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("all"))  # one row a range of the file
    begins = "aggregate(slice(all, 1, i), 0, (s, r) -> element_at(r.ends, s + 1))"
    begins = ranges.selectExpr("file", f"inline(transform(all, (r, i) -> struct(r.block AS block, {begins} AS begins)))")
    # By a hash of its own: dealt by file and block, the join's partitions would be taken, and a skewed join may split a range.
    placed = raw.join(begins, ["file", "block"]).repartition(F.xxhash64("file", "block")).sortWithinPartitions("file", "block", "at")
    pieces = placed.select("file", "block", "begins", "value").mapInArrow(_cut, PIECE)
    whole = pieces.where("ends and not open").select("file", "block", "seq", F.col("piece").alias("text"))
    # A record that crosses borders: its number is that of the first pieces up to here.
    order = Window.partitionBy("file").orderBy("block", "seq")
    broken = pieces.where("open or not ends").withColumn("no", F.sum(F.when(F.col("open"), 0).otherwise(1)).over(order))
    broken = broken.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "piece", "ends"))).alias("p"))
    broken = broken.where(F.element_at("p", -1)["ends"]).select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join("p.piece", ";").alias("text"))
    return whole.unionByName(broken).mapInArrow(_without_comments, "file string, block long, seq long, text string")


#: Fixed values of the format: escapes of a string, first the longer ones.
ESCAPE = r"\\X2\\(?:[0-9A-Fa-f]{4})+\\X0\\|\\X4\\(?:[0-9A-Fa-f]{8})+\\X0\\|\\X\\[0-9A-Fa-f]{2}|\\S\\.|\\P[A-I]\\|\\\\|[^\\]+|\\"


def decoded(text: Column) -> Column:
    """A string without its escapes: UTF-16, UTF-32 and single bytes in hexadecimal, shifted characters, backslashes.

    Bytes and shifted characters are those of ISO 8859-1; directives for other pages are dropped.
    """

    def one(t: Column) -> Column:
        digits = F.regexp_extract(t, r"^\\X[24]?\\([0-9A-Fa-f]+)", 1)
        shifted = F.unhex(F.hex(F.ascii(F.substring(t, 4, 1)) + 128))
        return (
            F.when(t.startswith("\\X2\\"), F.decode(F.unhex(digits), "UTF-16BE"))
            .when(t.startswith("\\X4\\"), F.decode(F.unhex(digits), "UTF-32"))
            .when(t.startswith("\\X\\") & (digits != ""), F.decode(F.unhex(digits), "ISO-8859-1"))
            .when(t.startswith("\\S\\") & (F.length(t) == 4), F.decode(shifted, "ISO-8859-1"))
            .when(t.rlike(r"^\\P[A-I]\\$"), "")
            .when(t == "\\\\", "\\")
            .otherwise(t)
        )

    return F.when(text.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({ESCAPE})"), F.lit(1)), one), "")).otherwise(text)
