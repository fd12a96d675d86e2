"""Exact top-k inner-product search over a pivot-distance index.

Vectors become integers by floor(256 x). One more component, sqrt(M^2 - |x|^2) with M the largest norm, gives all
candidates the same norm; queries get zero there. Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products
are the nearest neighbours and the triangle inequality applies.

Index: each vector is keyed by its nearest pivot and its distance from it, and rows are sorted by that key, so runs of
``ANNULUS`` rows of one pivot are annuli. A query at distance d from a pivot has every vector of the annulus [low, high]
at distance max(0, d - high, low - d) at least. Annuli are taken by that bound, nearest first; a query stops at the
first one whose bound exceeds its k-th best distance, as all that follow are no nearer. Scores are exact integers;
only bounds are floating-point, and they are widened by more than their rounding error.

Pivots are fitted on at most ``SAMPLE`` vectors, drawn by a hash of the id; every vector is indexed. The k-th best score in
that sample bounds every query's search from the start, in each partition. Queries go out in
blocks of ``QUERIES`` rows, whose size does not depend on the data; each task keeps k rows per query of a block, and
these are merged by a grouped aggregate. Recall is 1: the index only decides the order of work.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
shorter vectors count as padded by zeros; every row but the query's own is a candidate, also one with the same id; ties
go to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, table

K = 5
PIVOTS = 64
SAMPLE = 8192
ANNULUS = 256
QUERIES = 16384
NONE = np.iinfo(np.int64).min
FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, padded by zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating-point matrix product where no partial sum can round."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that brings their norm to ``top``."""
    rest = top**2 - np.einsum("ij,ij->i", x, x, dtype=np.float64)
    return np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(rest, 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly drawn rows."""
    pivots = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, pivots).argmin(axis=1)
        for i in range(len(pivots)):
            if (own := near == i).any():
                pivots[i] = x[own].mean(axis=0)
    return pivots


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.uid = np.full((n, k), -1)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Offer the same candidates to each query in ``rows``; one of score ``NONE`` is left out."""
        keep = np.flatnonzero((score >= self.score[rows, -1:]).any(axis=0))
        if not len(keep):
            return
        s = np.concatenate([self.score[rows], score[:, keep]], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids[keep], (len(rows), len(keep)))], axis=1)
        u = np.concatenate([self.uid[rows], np.broadcast_to(uids[keep], (len(rows), len(keep)))], axis=1)
        u = np.where(s == NONE, -1, u)
        order = np.lexsort((u, i, -1 - s), axis=1)[:, : self.k]  # -1 - s reverses the order and cannot overflow
        self.score[rows], self.id[rows], self.uid[rows] = (np.take_along_axis(v, order, axis=1) for v in (s, i, u))


def search(x: np.ndarray, ids: np.ndarray, uids: np.ndarray, near: np.ndarray, d: np.ndarray, queries: dict, best: Best) -> None:
    """Offer rows sorted by (pivot, distance) to ``best``, annulus by annulus."""
    q, own, to_pivot, square, top, floor = (queries[n] for n in ("x", "uid", "distance", "square", "top", "floor"))
    starts = [s for a, b in _runs(near) for s in range(a, b, ANNULUS)]
    ends = [min(s + ANNULUS, b) for a, b in _runs(near) for s in range(a, b, ANNULUS)]
    if not starts:
        return
    slack = 1e-6 * (top + 1)

    def reach(rows: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th best so far, at most that of its k-th best in the sample; infinite without either."""
        score = np.where(best.uid[rows, -1] < 0, floor[rows], np.maximum(best.score[rows, -1], floor[rows]))
        far = np.sqrt(np.maximum(square[rows] + top**2 - 2 * score.astype(np.float64), 0)) + slack
        return np.where(score == NONE, np.inf, far)

    pivot, low, high = near[starts], d[starts], d[np.array(ends) - 1]
    for g in np.unique(queries["near"]):  # queries of one pivot want the annuli in about the same order
        rows = np.flatnonzero(queries["near"] == g)
        dq = to_pivot[rows][:, pivot]
        bound = np.maximum(np.maximum(dq - high, low - dq), 0) - slack
        order = np.argsort(bound.min(axis=0), kind="stable")
        left = np.minimum.accumulate(bound[:, order][:, ::-1], axis=1)[:, ::-1]  # the least bound from here on
        alive = np.arange(len(rows))
        for turn, a in enumerate(order):
            far = reach(rows[alive])
            stay = left[alive, turn] <= far
            alive, far = alive[stay], far[stay]
            if not len(alive):
                break
            now = alive[bound[alive, a] <= far]
            if len(now):
                s, e = starts[a], ends[a]
                score = products(q[rows[now]], x[s:e])
                score[own[rows[now]][:, None] == uids[None, s:e]] = NONE
                best.add(rows[now], score, ids[s:e], uids[s:e])


def _runs(near: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(near)) + 1
    edges = [0, *cuts.tolist(), len(near)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with all other rows."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    width, square = rows.agg(F.max(F.size("x")), F.max(norm)).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = math.sqrt(square) * (1 + 1e-12)
    sample = rows.select("x", "uid", F.xxhash64("uid").alias("h")).orderBy("h").limit(SAMPLE).collect()
    padded = np.zeros((len(sample), width), np.int64)
    for i, r in enumerate(sample):
        padded[i, : len(r[0])] = r[0]
    drawn = padded, np.array([r[1] for r in sample], np.int64)
    model = spark.sparkContext.broadcast((fit_pivots(lifted(padded, top), PIVOTS), width, top))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, width, top = model.value
        for batch in batches:
            d = distances(lifted(matrix(batch.column("x"), width), top), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], [*batch.schema.names, "pivot", "distance"])

    index = rows.mapInArrow(key, "id long, x array<long>, query boolean, uid long, pivot int, distance double")
    index = cut(index.repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance"))
    queries = index.where("query").select("id", "x", "uid")
    n = queries.count()
    found = None
    for block in range(max(1, math.ceil(n / QUERIES))):
        part = queries.where(F.pmod(F.xxhash64("uid"), F.lit(max(1, math.ceil(n / QUERIES)))) == block)
        sent = spark.sparkContext.broadcast(_block(part.toArrow(), model.value, drawn, k))
        out = index.select("id", "x", "uid", "pivot", "distance").mapInArrow(_searcher(model, sent, k), FOUND)
        found = out if found is None else found.unionByName(out)
    best = found.groupBy("query_uid", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "uid"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("i", "b"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def floors(x: np.ndarray, own: np.ndarray, drawn: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th best score of each query among the sample: no task need look at what is below it."""
    sample, uids = drawn
    out = np.full(len(x), NONE)
    for at in range(0, len(x) if len(sample) >= k else 0, 512):
        score = products(x[at : at + 512], sample)
        score[own[at : at + 512, None] == uids[None, :]] = NONE
        out[at : at + 512] = np.partition(score, -k, axis=1)[:, -k]
    return out


def _block(queries: pa.Table, model: tuple, drawn: tuple[np.ndarray, np.ndarray], k: int) -> dict:
    """A block of queries with all that a task needs of them."""
    pivots, width, top = model
    queries = queries.combine_chunks()
    lists = queries.column("x").combine_chunks() if queries.num_rows else pa.array([], pa.list_(pa.int64()))
    x = matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists, width)
    flat = np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1)
    d = distances(flat, pivots)
    ids, uids = (queries.column(c).to_numpy() for c in ("id", "uid"))
    return {"x": x, "id": ids, "uid": uids, "distance": d, "near": d.argmin(axis=1), "square": (flat**2).sum(axis=1), "top": top, "floor": floors(x, uids, drawn, k)}


def _searcher(model, sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.value[1]
        queries = sent.value
        best = Best(len(queries["x"]), k)
        for batch in batches:  # rows come sorted, so a batch is a run of annuli
            near, d, ids, uids = (batch.column(c).to_numpy() for c in ("pivot", "distance", "id", "uid"))
            search(matrix(batch.column("x"), width), ids, uids, near, d, queries, best)
        q, at = np.nonzero(best.uid >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries["uid"][q]), pa.array(queries["id"][q]), pa.array(best.uid[q, at]), pa.array(best.id[q, at]), pa.array(best.score[q, at])],
            ["query_uid", "query_id", "uid", "vec_id", "score"],
        )

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every ``embeddings`` row whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
