"""URL rules judged through a Bloom filter cascade.

A cascade answers set membership exactly for every key of a universe that was known when it was built: level 1
encodes the listed keys, level 2 the universe's keys that level 1 takes for listed ones, level 3 the listed keys that
level 2 takes for those, and so on until a level has no false positives. A key's answer is read off the first level
that rejects it. Here the listed keys are the rules (``host + path``) and the universe is every (host suffix, path
prefix) of the corpus that has the shape of a rule, so no url is ever joined with the list.

Size: with r rules and s keys in the universe level 1 gets a false-positive rate near r / (sqrt 2 * s), so about
1.44 * r * log2(s / r) bits, and the false positives that later levels hold are about r. The broadcast thus grows with
the rules and only with the logarithm of the corpus; ``max_rules`` bounds it and :func:`build` re-draws a level whose
false positives exceed their bound.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated
rows are judged alike; a null id is kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, splitmix, table

#: Fixed values of the query's contract: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` packed, ``k`` probes, a seed of its own."""

    size: int
    k: int
    seed: int
    bits: np.ndarray

    def positions(self, h: np.ndarray) -> np.ndarray:
        """Probe positions, shape (k, n), of keys given by two 64-bit hashes each, shape (n, 2)."""
        a = splitmix(h[:, 0] ^ np.uint64(self.seed))
        b = splitmix(h[:, 1] + np.uint64(self.seed)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return (a + np.arange(self.k, dtype=np.uint64)[:, None] * b) % np.uint64(self.size)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.positions(h)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)

    @classmethod
    def of(cls, keys: np.ndarray, rate: float, seed: int) -> Level:
        k = max(1, math.ceil(math.log2(1 / rate)))
        size = max(64, math.ceil(len(keys) * k / math.log(2)))
        level = cls(size, k, seed, np.zeros(size // 8 + 1, np.uint8))
        at = level.positions(keys).ravel()
        np.bitwise_or.at(level.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return level


@dataclass(frozen=True)
class Cascade:
    """Levels of alternating meaning: odd ones encode listed keys, even ones the false positives so far."""

    levels: tuple[Level, ...]

    def has(self, h: np.ndarray) -> np.ndarray:
        """Exact membership of universe keys, given by their hashes."""
        out = np.zeros(len(h), bool)
        alive = np.arange(len(h))
        for i, level in enumerate(self.levels):
            passed = level.has(h[alive])
            out[alive[~passed]] = i % 2 == 1
            alive = alive[passed]
        out[alive] = len(self.levels) % 2 == 1
        return out

    @classmethod
    def above(cls, first: Level, listed: np.ndarray, false: np.ndarray) -> Cascade:
        """The cascade on a first level of which ``false`` are all false positives within the universe."""
        levels, encode, test = [first], false, listed
        while len(encode):
            if len(levels) > 200:
                raise ValueError("a listed key and another key of the universe share both hashes")
            level = Level.of(encode, 0.5, len(levels) + 1 + first.seed)
            encode, test = test[level.has(test)], encode
            levels.append(level)
        return cls(tuple(levels))


def hashes(keys: Sequence[str]) -> np.ndarray:
    """The two hashes of each key, as :func:`_hash_columns` has them."""
    pairs = [(xxhash.xxh64_intdigest(k.encode(), 42), xxhash.xxh64_intdigest(k.encode() + b"\0", 42)) for k in keys]
    return np.array(pairs, np.uint64).reshape(-1, 2)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Every (host suffix, path prefix) of a url that has as many labels and as long a path as some rule."""
    labels = F.split(host, r"\.")
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    keys = [
        F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    return F.array_compact(F.array(*keys))


def _keyed(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keyed = split.select("id", "host", "path", candidate_keys(F.col("host"), F.col("path"), rules).alias("keys"))
    return keyed.select(
        "*",
        F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"),
        F.transform("keys", lambda k: F.xxhash64(F.concat(k, F.lit("\0")))).alias("h2"),
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row number, hashes and key of each candidate of a batch."""
    keys = batch.column("keys")
    rows = pc.list_parent_indices(keys).to_numpy(zero_copy_only=False)
    pair = [batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2")]
    return rows, np.stack(pair, axis=1), keys.flatten()


def build(keyed: DataFrame, listed: Sequence[str], tries: int = 8) -> Cascade:
    """The cascade of ``listed`` over all keys in ``keyed``; two scans, and a bounded collect of false positives."""
    spark, h = keyed.sparkSession, hashes(listed)
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    rate = min(0.5, len(listed) / (math.sqrt(2) * max(total, 1)))
    known = spark.sparkContext.broadcast(set(listed))
    for turn in range(tries):
        first = Level.of(h, rate / 2**turn, 1000 * (turn + 1))
        sent = spark.sparkContext.broadcast(first)

        def wrong(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, h, keys = _flat(batch)
                found = [k for k in keys.filter(pa.array(sent.value.has(h))).to_pylist() if k not in known.value]
                yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.string())})

        bound = 4 * len(listed) + 64
        false = [r[0] for r in keyed.mapInArrow(wrong, "key string").distinct().limit(bound + 1).collect()]
        if len(false) <= bound:
            return Cascade.above(first, h, hashes(sorted(false)))
    raise ValueError("level 1 keeps too many false positives")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = 2_000_000,
) -> DataFrame:
    """Per url: id, host, path, the longest fitting rule and its verdict, or null and ``default``.

    ``rules`` are (verdict, host, path); one fits its host and all subdomains, if the url's path starts with its own.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    spark = pages.sparkSession
    bound_batches(spark)
    keyed = _keyed(pages, id_col, url_col, rules)
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    if not rules:
        return keyed.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocked, allowed = ([h + p for v, h, p in rules if v == x] for x in ("block", "allow"))
    listed = build(keyed, blocked + allowed)
    first = Level.of(hashes(blocked), 0.5, 7) if blocked else None
    h = hashes(allowed)
    verdicts = Cascade.above(first, hashes(blocked), h[first.has(h)] if len(h) else h) if blocked else None
    sent = spark.sparkContext.broadcast((listed, verdicts))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, verdicts = sent.value
        for batch in batches:
            rows, h, keys = _flat(batch)
            hit = np.flatnonzero(listed.has(h))
            rows, h, keys = rows[hit], h[hit], keys.take(pa.array(hit))
            length = pc.utf8_length(keys).to_numpy(zero_copy_only=False)
            order = np.lexsort((length, rows))
            last = order[np.append(np.diff(rows[order]) != 0, True)] if len(order) else order
            rule = np.full(batch.num_rows, None, object)
            verdict = np.full(batch.num_rows, default, object)
            rule[rows[last]] = keys.take(pa.array(last)).to_pylist()
            stop = verdicts.has(h[last]) if verdicts else np.zeros(len(last), bool)
            verdict[rows[last]] = np.where(stop, "block", "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return keyed.mapInArrow(decide, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by the rules above."""
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
r(verdict, host, path) AS (VALUES {rules}),
f AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict AS verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
""".format(rules=", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES))
