"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents are encoded and cut where a sequence is full, so all pieces but a document's last are whole sequences. The
histogram of piece lengths, at most ``LENGTH`` numbers, goes to the driver. There lengths are placed longest first, all
pieces of a length at once: they join the shortest packs with room for them, and the counts of packing patterns are
updated; what finds no room opens new packs, as many to a pack as it holds. The patterns say, for each length, which ranks among the pieces of that
length go to which sequence and offset. Their number depends on ``LENGTH`` alone, and so does the broadcast.

A piece's rank among those of its length is its rank within its partition, known when it was written, plus the number of
such pieces in earlier partitions: a sum over (length, partition) counts. No length's pieces ever meet in one task.

Defined results: null text is empty, and has the end id alone; repeated rows are documents of their own; a null id is
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, each_text, store, table
from .tokens import words

LENGTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Pattern = tuple[int, tuple[int, ...]]


def pack(histogram: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """(count, piece lengths) of each packing pattern, for a histogram of piece lengths."""
    open_: dict[int, list[Pattern]] = defaultdict(list)  # by room left
    full: list[Pattern] = []

    def put(count: int, pieces: tuple[int, ...], room: int) -> None:
        (open_[room] if room else full).append((count, pieces))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for room in sorted((r for r in open_ if r >= size), reverse=True):  # most room first: the shortest packs
            while left and open_[room]:
                count, pieces = open_[room].pop()
                taken = min(count, left)
                left -= taken
                if count > taken:
                    open_[room].append((count - taken, pieces))
                put(taken, (*pieces, size), room - size)
            if not open_[room]:
                del open_[room]
            if not left:
                break
        each = length // size  # a new pack has room for more of the same length, and is then the shortest with room
        if left >= each:
            put(left // each, (size,) * each, length - size * each)
        if left % each:
            put(1, (size,) * (left % each), length - size * (left % each))
    return full + [p for room in sorted(open_) for p in open_[room]]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Sorted rows (length, first rank, first sequence, offset): where runs of ranks of each length go."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pieces in patterns:
        offset = 0
        for size in pieces:
            rows.append((size, used[size], sequence, offset))
            used[size] += count
            offset += size
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document, with its partition and its place among those of its length there."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = words(path).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch, texts in each_text(batches, "text"):
            row, start, size, crc, total, place = [], [], [], [], [], []
            for i, text in enumerate(texts):
                ids = encode(text) + end
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    n = len(piece) // 4
                    row.append(i)
                    start.append(at // 4)
                    size.append(n)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
                    place.append(seen[n])
                    seen[n] += 1
            columns = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            ids_ = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_, *columns, pa.array(np.full(len(row), part, np.int32)), pa.array(place, pa.int64())],
                [x.split()[0] for x in PIECES.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and offset; sequences are numbered from 0 without gaps."""
    spark = docs.sparkSession
    cut = store(pieces(docs, path or public_tokenizers.path(VOCABULARY), length, end_id), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("rank"))
    sent = spark.sparkContext.broadcast(slots(pack(histogram, length)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (size << 48) + rank, "right") - 1
            placed = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *placed], [x.split()[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(place, PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` in sequences of at most 2048 ids."""
    return sequences(table(spark, sf_dir, "documents"))
