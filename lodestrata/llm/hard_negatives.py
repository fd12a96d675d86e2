"""Hard-negative mining by blocked dense matrix products.

Components become integers by floor(256 x), x as double. Anchors go out in blocks of at most about ``ANCHORS`` rows (fewer
where vectors are wide), whose size does not depend on the data; every task multiplies its candidates with a block, ``TILE``
anchors at a time. Products are in float64 where no partial sum can reach 2^53, so that each is the exact integer, and
in 64-bit integers beyond. Two passes a block:

1. each task keeps, per anchor, its k best candidates of the anchor's label; lists of all tasks merge into the
   anchor's positives by a ranked window, which keeps k rows a key before and after its shuffle;
2. each positive gives the anchor a window of scores, and each task keeps the k best candidates of other labels in each
   window; they merge alike.

The result of a block is appended to a table in the shared folder, so plan and lineage do not grow with the number of
blocks. The work is (anchors x rows) products, in blocks against all rows; a hot label only changes which products count.

Defined results: rows with a null id, a null label, a null vector, or null or non-finite components take no part; shorter
vectors count as padded by zeros; every row but the anchor's own is a candidate, also one with the same id; ties go to the
smaller id; fewer candidates give fewer rows, an anchor without positives or a positive without negatives none; rows that
repeat are anchors of their own; an empty table gives an empty result. A score that a long cannot be sure to hold (width x
largest component squared reaches 2^63) is an error, not a wrapped number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, scratch_path, table
from .pivot_search import integers, matrix, usable

POSITIVES = 5
NEGATIVES = 10
#: A negative's score is at least LOW and at most HIGH tenths of its positive's.
LOW, HIGH = 3, 9
#: Anchors of one block, and bytes of their vectors; anchors multiplied at once.
ANCHORS = 4096
BLOCK_BYTES = 16 << 20
TILE = 512
EXACT = 2.0**53
LEAST = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def products(a: np.ndarray, x: np.ndarray, exact_in_float: bool) -> np.ndarray:
    """Exact inner products of integer rows, as int64."""
    return np.rint(a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact_in_float else a @ x.T


def tenths_down(score: np.ndarray, tenths: int) -> np.ndarray:
    """floor(score * tenths / 10) without an overflow between."""
    return score // 10 * tenths + score % 10 * tenths // 10


def bounds(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole score between ``low`` and ``high`` tenths of each score; none below zero."""
    return -tenths_down(-score, low), tenths_down(score, high)


class Lists:
    """The k best (largest score, then smallest id) of each of n lists so far; lists of several tasks can be merged."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Offer to list ``lists[i]`` the candidates j with ``fits[i, j]``, of score ``score[i, j]`` and id ``ids[j]``."""
        fits = fits & (score >= self.score[lists, -1:])
        crowded = np.flatnonzero(np.count_nonzero(fits, axis=1) > 4 * self.k)
        if len(crowded):  # what is below the k-th of this batch alone cannot stay
            own = np.where(fits[crowded], score[crowded], LEAST)
            fits[crowded] &= score[crowded] >= np.partition(own, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(fits)
        if not len(i):
            return
        rows = np.unique(i)
        old_i, old_at = np.nonzero(self.score[lists[rows]] > LEAST)
        old_list = lists[rows[old_i]]
        key = np.concatenate([lists[i], old_list])
        value = np.concatenate([score[i, j], self.score[old_list, old_at]])
        ident = np.concatenate([ids[j], self.id[old_list, old_at]])
        order = np.lexsort((ident, -1 - value, key))
        key, value, ident = key[order], value[order], ident[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        keep = place < self.k
        self.score[key[keep], place[keep]] = value[keep]
        self.id[key[keep], place[keep]] = ident[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, id, score) of everything kept."""
        i, at = np.nonzero(self.score > LEAST)
        return i, self.id[i, at], self.score[i, at]


def _positives(sent, k: int):
    """First pass: (anchor's place in the block, id, score) of each task's best of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = Lists(len(block["x"]), k)
        for batch in batches:
            ids, uids, labels = (batch.column(c).to_numpy() for c in ("id", "uid", "label"))
            x = matrix(batch.column("x"), block["x"].shape[1])
            for label in np.intersect1d(labels, block["label"]):
                own, there = np.flatnonzero(block["label"] == label), np.flatnonzero(labels == label)
                for at in range(0, len(own), TILE):
                    a = own[at : at + TILE]
                    other = block["uid"][a, None] != uids[None, there]
                    best.offer(a, products(block["x"][a], x[there], block["float"]), ids[there], other)
        yield from _table(*best.rows())

    return run


def _negatives(sent, k: int):
    """Second pass: (anchor's place x positives + positive's place, id, score) of each task's best in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        low, high = block["low"], block["high"]
        windows = low.shape[1]
        best = Lists(low.size, k)
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
            x = matrix(batch.column("x"), block["x"].shape[1])
            for at in range(0, len(low), TILE):
                a = np.arange(at, min(at + TILE, len(low)))
                score = products(block["x"][a], x, block["float"])
                other = block["label"][a, None] != labels[None, :]
                for p in range(windows):
                    best.offer(a * windows + p, score, ids, other & (score >= low[a, p, None]) & (score <= high[a, p, None]))
        yield from _table(*best.rows())

    return run


def _table(place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids), pa.array(score)], ["place", "id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each place with their rank; a key has k rows per task at most, and Spark cuts to k before the shuffle."""
    order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """For each anchor and each of its first positives the first negatives whose score is ``low`` to ``high`` tenths of the positive's."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    rows = rows.withColumn("x", integers(F.col("v"))).withColumn("most", F.array_max(F.transform("v", lambda v: F.abs(v.cast("double")))))
    rows = cut(rows.select("id", "label", "x", "most", "anchor").withColumn("uid", F.monotonically_increasing_id()))
    width, most, n = rows.agg(F.max(F.size("x")), F.max("most"), F.count_if("anchor")).first()
    path = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    if not n or not width:  # no anchor, or vectors without components: every score is zero
        most, width = most or 0.0, width or 1
    largest = width * (256.0 * (most or 0.0) + 1) ** 2
    if largest >= 2.0**63:
        raise ValueError(f"components up to {most} in {width} dimensions: inner products may not fit a long")
    rows = rows.drop("most")
    blocks = math.ceil(n / max(1, min(ANCHORS, BLOCK_BYTES // (8 * width))))
    for block in range(blocks):
        part = rows.where("anchor").where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).select("id", "uid", "label", "x")
        _one_block(rows, part, width, largest < EXACT, path, positives, negatives, low, high)
    return spark.read.schema(RESULT).parquet(path)


def _one_block(rows: DataFrame, part: DataFrame, width: int, in_float: bool, path: str, positives: int, negatives: int, low: int, high: int) -> None:
    """Both passes for one block of anchors; appends to the table at ``path``. The driver holds this block's rows only."""
    spark = rows.sparkSession
    anchors = part.toArrow().combine_chunks()
    if not anchors.num_rows:
        return
    ids, uids, labels = (anchors.column(c).to_numpy() for c in ("id", "uid", "label"))
    block = {"x": matrix(anchors.column("x").chunk(0), width), "uid": uids, "label": labels, "float": in_float}
    kind = "place long, id long, score long"
    sent = spark.sparkContext.broadcast(block)
    first = _merged(rows.select("id", "uid", "label", "x").mapInArrow(_positives(sent, positives), kind), positives).toArrow()
    sent.destroy()
    # No window where an anchor has fewer positives: low above high.
    place, rank = first.column("place").to_numpy(), first.column("rank").to_numpy() - 1
    lows, highs = np.full((len(uids), positives), 1), np.full((len(uids), positives), 0)
    score, pid = np.zeros((len(uids), positives), np.int64), np.zeros((len(uids), positives), np.int64)
    score[place, rank], pid[place, rank] = first.column("score").to_numpy(), first.column("id").to_numpy()
    lows[place, rank], highs[place, rank] = bounds(first.column("score").to_numpy(), low, high)
    sent = spark.sparkContext.broadcast(block | {"low": lows, "high": highs})
    second = _merged(rows.select("id", "label", "x").mapInArrow(_negatives(sent, negatives), kind), negatives)
    names = pa.table({"place": np.arange(lows.size), "anchor_id": np.repeat(ids, positives), "positive_id": pid.ravel(), "positive_score": score.ravel()})
    named = second.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(spark.createDataFrame(names)), "place")
    named.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in RESULT.split(", "))).write.mode("append").parquet(path)
    sent.destroy()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are ids divisible by 100; where an id is divisible by 7 the label moves on by one first, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
