"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def labelled(docs: DataFrame, labels: DataFrame, column: str, known: Column, sizes: Sequence[int]) -> tuple[DataFrame, list[int]]:
    """(label, h, text) of at most ``sizes[label]`` labelled ids for labels 0 and 1, and how many ids had each label.

    ``known`` says which ids may be learned from. Ids are drawn by their hash, so the draw is even and always the same;
    it is taken by a distributed top-k, and only the drawn ids, whose number is bounded, are broadcast. An id with both
    labels, or a label other than 0 and 1, is not learned from.
    """
    rows = labels.where(known & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("other"))
    rows = cut(rows.where("label = other").select("id", "label", F.xxhash64("id").alias("h")))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    drawn = [rows.where(F.col("label") == k).orderBy("h", "id").limit(n) for k, n in enumerate(sizes)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut(text.join(drawn, "id").select("label", "h", "text")), [counts.get(0, 0), counts.get(1, 0)]
