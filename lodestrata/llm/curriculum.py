"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight, which sets its share of all words, and a shape, which says how its weight moves over the run: a
piecewise-linear curve whose integral over [0, 1] is one. Targets: shares of the total by weight; a target stops at
``most`` times its source's size, and the excess goes to the others by weight, until none is above. A source's documents
form a stream in the order of a hash, repeated as often as the target needs; the stream ends at the target, inside a
document if need be, so a source's taken words are its target rounded. The integral of a source's shape times its target is
the demand up to a time; inverting it gives the time at which a place of the stream is wanted, and all sources' demands up to that
time, added up, are the training position in words. The result is sorted by position over a range exchange.

Places in a stream are sums in three steps, so that no task holds a source: words per (source, first four hex digits of
the hash), the sums of their first two digits (256 a source), and a window within one of the 65,536 buckets of a source.
Sources are a table of their own, numbered and levelled by aggregates; its rows never reach the driver.

Defined results: a null text has size zero; a null source is a source, last in order; a null id hashes like an empty
text; rows that repeat are documents of their own; a document of size zero, or beyond its source's target, takes nothing and
has a null position; sources without words have target zero; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Weights of the sources in their order, repeating, and the shape of each: points (time, weight).
WEIGHTS = (1, 2, 3)
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: No document is taken more often.
MOST = 3
#: Shapes are part of expressions, so their points are bounded.
POINTS = 64
SPACE = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    """Number of maximal runs of other than blanks; the whole text, without a list of its words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.length(F.regexp_replace(text, f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", "x"))
    return F.when(text.rlike(f"[^{SPACE}]"), marks).otherwise(0).cast("long")


class Shape:
    """A piecewise-linear weight over [0, 1], scaled to integral one, with its integral and the inverse of that."""

    def __init__(self, points: Sequence[tuple[float, float]]) -> None:
        times, weights = [p[0] for p in points], [p[1] for p in points]
        if not 2 <= len(points) <= POINTS or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])):
            raise ValueError(f"a shape has 2 to {POINTS} points at rising times from 0 to 1")
        areas = [(b - a) * (v + w) / 2 for a, b, v, w in zip(times, times[1:], weights, weights[1:])]
        if min(weights) < 0 or sum(areas) <= 0:
            raise ValueError("a shape's weights are not negative and not all zero")
        scale = sum(areas)
        slopes = [(w - v) / (b - a) / scale for a, b, v, w in zip(times, times[1:], weights, weights[1:])]
        #: (start, end, weight at start, slope, integral up to start) of each piece
        self.pieces = [(a, b, v / scale, m, sum(areas[:i]) / scale) for i, (a, b, v, m) in enumerate(zip(times, times[1:], weights, slopes))]

    def integral(self, t: Column) -> Column:
        def one(piece: tuple) -> Column:
            a, _, v, m, before = piece
            x = t - F.lit(a)
            return F.lit(before) + F.lit(v) * x + F.lit(m) * x * x / F.lit(2.0)

        return self._choose(t, 1, one)

    def inverse(self, u: Column) -> Column:
        """A time at which the integral is ``u``, for u from 0 to 1; any of those of a stretch without weight."""

        def one(piece: tuple) -> Column:
            a, _, v, m, before = piece
            rest = u - F.lit(before)
            root = F.lit(v) + F.sqrt(F.greatest(F.lit(v * v) + F.lit(2.0) * rest * F.lit(m), F.lit(0.0)))
            return F.lit(a) + F.when((rest <= 0) | (root <= 0), 0.0).otherwise(F.lit(2.0) * rest / root)

        return self._choose(u, 4, one)

    def _choose(self, value: Column, field: int, one) -> Column:
        """The piece whose range holds the value: by its end for times, by the next one's integral for amounts."""
        out = one(self.pieces[-1])
        for i in range(len(self.pieces) - 2, -1, -1):
            edge = self.pieces[i][1] if field == 1 else self.pieces[i + 1][4]
            out = F.when(value <= F.lit(edge), one(self.pieces[i])).otherwise(out)
        return out


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``no``: the rows' places from 0 in the order, by one range exchange and one count a partition."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()  # the partition, and below 33 bits the row's place in it
    rows = rows.select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before, total = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "part int, before long")
    return cut(rows.join(F.broadcast(offsets), "part").withColumn("no", F.col("at") + F.col("before")).drop("part", "at", "before"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``target`` double of each source from its ``weight`` and ``source_size``; their sum is that of the sizes.

    Each round takes the sources whose share is above ``most`` times their size out, at that bound, and shares the rest anew: shares
    only rise, so a source that is out stays out. Two sums a round reach the driver.
    """
    cap = F.lit(most) * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, out = 0.0, 0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, fixed, weight = sources.agg(F.count_if(above), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if level and n == out or not weight:
            break
        out, level = n, float(total - fixed) / float(weight)
        if not level:
            break
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS, shapes: Sequence[Sequence[tuple[float, float]]] = SHAPES, most: int = MOST,
) -> DataFrame:
    """Per document: id, key, source_no, size, source_size, target, taken, copies (array of copy, start, words, position), row (``keep``).

    ``start`` is the place in the source's stream, ``words`` what the copy gives (the document's words from its first on).
    """
    curves = [Shape(points) for points in shapes]
    if len(curves) != len(weights):
        raise ValueError("one shape a weight")
    source = F.col(source_col).cast("string")
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("name"),
        n_words(F.col(text_col)).alias("size"), key.alias("key"), F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("bucket"), kept.alias("row"),
    )
    rows = cut(rows)
    buckets = cut(rows.groupBy("name", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source")))
    sources = buckets.groupBy("name").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    sources = numbered(sources, F.col("source").isNull(), F.col("source")).withColumnRenamed("no", "source_no")
    turn = (F.col("source_no") % len(weights)).cast("int")
    sources = sources.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    sources = cut(targets(sources, most).withColumn("budget", F.round("target").cast("long")).drop("source", "weight"))
    demand = dict(map(tuple, sources.groupBy("turn").agg(F.sum("budget")).collect()))

    coarse = buckets.groupBy("name", F.shiftright("bucket", 8).alias("half")).agg(F.sum("words").alias("words"))
    coarse = coarse.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("half", "words"))).alias("halves"))  # 256 at most
    before = "aggregate(slice(halves, 1, i), 0L, (s, h) -> s + h.words)"
    coarse = coarse.selectExpr("name", f"inline(transform(halves, (h, i) -> struct(h.half AS half, {before} AS base)))")
    within = Window.partitionBy("name", "half").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fine = buckets.withColumn("half", F.shiftright("bucket", 8)).withColumn("fine", F.coalesce(F.sum("words").over(within), F.lit(0)))
    offsets = fine.join(coarse, ["name", "half"]).join(sources, "name")
    offsets = cut(offsets.select("name", "bucket", (F.col("base") + F.col("fine")).alias("base"), "source_no", "source_size", "turn", "target", "budget"))

    order = Window.partitionBy("name", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("here", F.coalesce(F.sum("size").over(order), F.lit(0))).join(offsets, ["name", "bucket"])
    first = F.col("base") + F.col("here")

    def copy(i: int) -> Column:
        start = first + F.lit(i) * F.col("source_size")
        words = F.greatest(F.least(F.col("budget") - start, F.col("size")), F.lit(0))
        share = start.cast("double") / F.col("budget").cast("double")
        at = F.coalesce(*(F.when(F.col("turn") == j, curve.inverse(share)) for j, curve in enumerate(curves)))
        return F.struct(F.lit(i).alias("copy"), start.alias("start"), words.alias("words"), F.when(words > 0, at).alias("time"))

    placed = placed.withColumn("all", F.filter(F.array(*map(copy, range(most))), lambda c: c["words"] > 0))

    def position(t: Column) -> Column:
        return sum((F.lit(float(demand.get(j, 0))) * curve.integral(t) for j, curve in enumerate(curves)), F.lit(0.0))

    copies = F.transform("all", lambda c: F.struct(c["copy"], c["start"], c["words"], position(c["time"]).alias("position")))
    taken = F.aggregate("all", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return placed.select("id", "key", "source_no", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), "row")


def training_order(docs: DataFrame, source_col: str = "source", **options) -> DataFrame:
    """The documents' own columns, repeated as the mix takes them, with copy, words and position, sorted by position.

    A column of ``docs`` whose name is one of the three is left out.
    """
    keep = [c for c in docs.columns if c not in ("copy", "words", "position")]
    pieces = assign(docs, source_col=source_col, keep=keep, **options).select("key", "id", "source_no", "row", F.explode("copies").alias("c"))
    pieces = pieces.orderBy("c.position", "source_no", "c.start", "key", "id")
    return pieces.select(*(F.col("row")[c].alias(c) for c in keep), "c.copy", "c.words", "c.position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, one row each, in the order of their first position; documents that are not taken come last."""
    mixed = assign(table(spark, sf_dir, "documents")).withColumn("position", F.try_element_at("copies", F.lit(1))["position"])
    mixed = mixed.orderBy(F.col("position").asc_nulls_last(), "source_no", "key", "id", "size")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.floor("position").alias("position"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
-- by rising 3 z / w: a source is at its bound if it is above with all before it at theirs
o AS (
  SELECT *, row_number() OVER (ORDER BY z / w, source NULLS LAST) AS no, sum(z) OVER () - coalesce(sum(3 * z) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w
  FROM s WINDOW before AS (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * (CAST(rest AS DOUBLE) / CAST(left_w AS DOUBLE)) > 3 * z AS above FROM o),
l AS (SELECT coalesce(arg_min(CAST(rest AS DOUBLE) / CAST(left_w AS DOUBLE), no) FILTER (NOT above), 0) AS level FROM f),
t AS (SELECT source, z, w, CASE WHEN w * level > 3 * z THEN CAST(3 * z AS DOUBLE) ELSE w * level END AS target FROM s, l),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
m AS (SELECT sum(budget) FILTER (w = 1) AS b1, sum(budget) FILTER (w = 2) AS b2, sum(budget) FILTER (w = 3) AS b3 FROM b),
p AS (
  SELECT d.doc_id, d.size, b.z, b.w, b.target, b.budget,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS a
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
x AS (
  SELECT *, greatest(least(budget - a, size), 0) AS t1, greatest(least(budget - a - z, size), 0) AS t2, greatest(least(budget - a - 2 * z, size), 0) AS t3,
    CASE WHEN budget > 0 THEN CAST(a AS DOUBLE) / CAST(budget AS DOUBLE) ELSE 0 END AS u
  FROM p),
y AS (
  SELECT *, CASE w WHEN 1 THEN 2.0::DOUBLE * u / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * u, 0)))
    WHEN 2 THEN u ELSE 2.0::DOUBLE * u / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * u)) END AS t
  FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target, CAST(t1 + t2 + t3 AS BIGINT) AS taken,
  CASE WHEN t1 > 0 THEN CAST(floor(CAST(coalesce(b1, 0) AS DOUBLE) * (1.5::DOUBLE * t - t * t / 2.0::DOUBLE)
    + CAST(coalesce(b2, 0) AS DOUBLE) * t + CAST(coalesce(b3, 0) AS DOUBLE) * (0.5::DOUBLE * t + t * t / 2.0::DOUBLE)) AS BIGINT) END AS position
FROM y, m
"""
