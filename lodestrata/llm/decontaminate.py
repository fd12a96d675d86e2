"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their shingles: a class of bound u holds the items of over u / 2 and up to u.
For each class a document of any length is seen as windows of 2u shingles at a stride of u, so that a passage of an
item's size lies whole in one window, and the window's size is within a factor of the item's whatever the document's
length. That keeps the Jaccard similarity of an item with a window that contains it at 0.8 * (u / 2) / (2u + u / 10),
about 0.19, in the worst case. With ``HASHES`` minima of one row each (the setting that a containment threshold over a
small query asks for) the chance to miss such a pair is 0.81 ** 64, about one in a million for the smallest items of a
class and below 1e-12 for those of its bound. A window's minima come from the minima of its two halves.

A candidate is an (item, document) whose minima agree at least once. It is verified against all shingles of the whole
document: it counts if at least ``threshold`` of the item's distinct shingles are in it. There are no false pairs.

The items go out in blocks of about ``BLOCK`` rows and ``BLOCK_CHARACTERS`` characters (one item of more is a block of its
own); documents are never shuffled.

Words are lower-cased runs between white space and punctuation, so case and punctuation don't hide a passage; a
shingle is five words. Defined results: null text is empty; an item of fewer than five words has its whole sequence as
its one shingle and is found in documents that are that sequence; an item without words is never found; repeated rows
give repeated results; a null id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, each_text, splitmix, table

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
#: Items that are broadcast at once, and characters of these.
BLOCK = 20_000
BLOCK_CHARACTERS = 32 << 20
#: Shingles whose minima are taken at once; a power of two.
SPAN = 1 << 13
#: Punctuation and blanks outside ASCII: Latin-1 signs, general punctuation, CJK punctuation.
MARKS = re.compile("[\u0085\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u303f]")
ASCII_MARKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
FOUND = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def words(text: str) -> list[bytes]:
    """Lower-case words in UTF-8, split at white space and punctuation."""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(ASCII_MARKS).split()


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the text's shingles in order, repeats included."""
    w = words(text)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        return np.array([digest(join(w))] if w else [], np.uint64)
    runs = zip(*(w[i:] for i in range(SHINGLE)))
    return np.fromiter((digest(join(run)) for run in runs), np.uint64, len(w) - SHINGLE + 1)


def salts(n: int = HASHES) -> np.ndarray:
    """An odd multiplier for each hash function."""
    return (splitmix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def permuted(h: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Shingles under each hash function, shape (functions, shingles); 32 bits are enough to propose candidates."""
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(32))).astype(np.uint32)[None, :] * salts[:, None]


class Items:
    """A block of benchmark items, indexed by size class."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.salts = salts()
        self.ids = ids
        self.sets = [np.unique(shingles(t)) for t in texts]
        by_bound: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_bound.setdefault(max(4, 1 << (len(s) - 1).bit_length()), []).append(i)
        self.classes = []
        for bound, own in sorted(by_bound.items()):
            keys = np.concatenate([permuted(self.sets[i], self.salts).min(axis=1) for i in own])
            order = np.argsort(keys, kind="stable")
            bits = min(26, (16 * len(keys)).bit_length())
            seen = np.zeros(1 << bits, bool)  # most minima are no item's; this tells it by one look-up
            seen[keys & np.uint32((1 << bits) - 1)] = True
            self.classes.append((bound, keys[order], np.repeat(own, HASHES)[order], seen, np.uint32((1 << bits) - 1)))

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document; memory does not depend on either's length."""
        found: set[int] = set()
        before: list[np.ndarray | None] = [None] * len(self.classes)  # minima of the half window before
        running: list[np.ndarray | None] = [None] * len(self.classes)  # of a half window that this part does not end
        for at in range(0, len(h), SPAN):
            values = permuted(h[at : at + SPAN], self.salts)
            for c, (bound, *_) in enumerate(self.classes):
                if bound <= SPAN:  # both are powers of two: halves end where parts do
                    half = np.minimum.reduceat(values, np.arange(0, values.shape[1], bound), axis=1)
                else:
                    least = values.min(axis=1, keepdims=True)
                    half = running[c] = least if running[c] is None else np.minimum(running[c], least)
                    if (at + SPAN) % bound and at + SPAN < len(h):
                        continue
                    running[c] = None
                joined = half if before[c] is None else np.concatenate([before[c], half], axis=1)
                before[c] = half[:, -1:]
                self._look(c, joined if joined.shape[1] < 2 else np.minimum(joined[:, 1:], joined[:, :-1]), found)
        return found

    def _look(self, c: int, window: np.ndarray, found: set[int]) -> None:
        _, keys, owner, seen, mask = self.classes[c]
        hit = np.unique(window[seen[window & mask]])
        for a, b in zip(np.searchsorted(keys, hit), np.searchsorted(keys, hit, "right")):
            found.update(owner[a:b].tolist())

    def contained(self, text: str, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, those in the text) for each item that the text contains."""
        h = shingles(text)
        if not len(h) or not self.classes:
            return
        own = None
        for i in sorted(self.candidates(h)):
            own = np.unique(h) if own is None else own
            item = self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[at] == item).sum())
            if shared >= threshold * len(item) - 1e-9:
                yield i, len(item), shared


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The items, in blocks of about ``BLOCK`` rows and ``BLOCK_CHARACTERS`` characters, as broadcasts."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK), -(-size // BLOCK_CHARACTERS))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = part.collect()
        yield items.sparkSession.sparkContext.broadcast(Items([r[0] for r in held], [r[1] or "" for r in held]))


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and item row whose containment is at least the threshold.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for sent in _blocks(items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch, texts in each_text(batches, "text"):
                ids = batch.column("doc_id").to_pylist()
                out = [(d, items.ids[i], n, k, k / n) for d, t in zip(ids, texts) for i, n, k in items.contained(t, threshold)]
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in FOUND.split(", ")])

        out = rows.mapInArrow(run, FOUND)
        found = out if found is None else found.unionByName(out)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; each row is judged by its own text, whatever its id."""
    bound_batches(docs.sparkSession)
    out = docs
    for sent in _blocks(items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch, texts in each_text(batches, "text"):
                yield batch.filter(pa.array([next(items.contained(t, threshold), None) is None for t in texts], pa.bool_()))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row against every ``benchmark`` item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
