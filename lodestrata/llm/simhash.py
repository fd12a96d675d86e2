"""SimHash near-duplicates: whole-text fingerprints, tiled exact comparison, components.

Equal fingerprints are one class, so copies are never paired. Two different fingerprints within ``RADIUS`` bits agree
on at least one of ``RADIUS + 1`` blocks of bits; each class is therefore dealt to one bucket per block, and only
fingerprints of one bucket are compared. A bucket is sorted by population count and cut into tiles of ``TILE``; two
tiles are compared by exclusive or and bit counts, unless their population counts differ by more than the radius, which
rules out every pair of them. Buckets of more than ``TILE`` classes are cut by a hash and dealt as pairs of parts, so that
no task holds more than two parts of a bucket. The comparison is exact: no candidate is dropped.

A task does not report the pairs it finds but a spanning forest of them, at most one link per fingerprint it holds.
Components come from repeated minimum propagation with pointer jumping over these links; every round is written to the
shared folder. Links, fingerprints and components stay distributed throughout.

Defined results: null text has no words; texts without words have fingerprint zero and link like any other; a component
is named by its smallest id, null if all its ids are null; repeated rows are copies of each other; an empty table
gives an empty result; further columns are ignored.

That is the query. Fingerprints within three of 64 bits are too few to clean a corpus by: of pairs whose shingles agree to
0.8 about one in a hundred is that near. :func:`deduplicate` therefore links rows whose sets of ``CORPUS_SHINGLE`` words have
a Jaccard similarity of ``SIMILARITY`` or more, by the same method with more bits. A set's fingerprint has ``BITS`` bits, of
which a pair at 0.8 differs in 15 % (19 % for sets of four and five shingles, the worst case). Fingerprints are dealt to a
bucket for each of ``BANDS`` bands of ``ROWS`` bits; a bucket is sorted by the size of the sets and compared tile by tile, and
two tiles are passed over if the sizes alone rule out the similarity. Pairs within ``NEAR`` bits (``NEAR_SMALL`` if a set has
under five shingles) are candidates. A pair at 0.8 meets in no bucket with a chance of 1e-9 (7e-7 in the worst case), and is
beyond the radius with one of 2e-7 (2e-6). From ``CROWD << ROWS`` classes on bands have more bits, so that buckets grow no
further, and there are more of them: bits are then used more than once.

A task reports a spanning forest of its candidates. Their components, the chains, are what may be linked: each member is verified
on the whole sets against its nearest and against the first of its chain. Chains that this has not made one are compared
whole, tile by tile: a chain is dealt as pairs of parts of at most ``MEMBERS`` members and ``WEIGHT`` shingles on average, a
task counts the shared shingles of all members of a tile by matrix products and reports a spanning forest of the links, so
no pair is ever a row. Texts without words are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, each_text, splitmix, store, table
from .components import connected

RADIUS = 3
SHINGLE = 3
SEED = 42
#: What the corpus pipeline calls near: words in a shingle, similarity of the sets, and how candidates are found.
CORPUS_SHINGLE = 5
SIMILARITY = 0.8
BITS = 256
BANDS = 42
ROWS = 6
#: Bits that candidates may differ in, also if a set has under five shingles.
NEAR = 70
NEAR_SMALL = 78
#: Classes of a bucket, on average, at which bands get more bits; how often these may miss a pair, and its share of other bits.
CROWD = 1 << 16
MISS = 1e-7
DIFFER = 0.1875
#: Rows and columns of a tile of wide fingerprints, and classes of a bucket that one part may hold.
LEFT = 128
RIGHT = 1 << 10
WIDE_PART = 1 << 17
#: Members and shingles of a part of a chain that is compared in tiles, and shingles that are counted at once.
MEMBERS = 1024
WEIGHT = 1 << 20
COLUMNS = 1 << 12
#: Fingerprints in a tile, and classes of a bucket that one part may hold.
TILE = 1024
PART = 16 * TILE
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased, repeats included; the whole sequence if it is shorter."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < words:
        return np.array([digest(join(w), SEED)] if w else [], np.uint64)
    runs = zip(*(w[i:] for i in range(words)))
    return np.fromiter((digest(join(run), SEED) for run in runs), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            fps = np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def tile_pairs(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of all pairs of different positions within the radius, tile pair by tile pair."""
    ones = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    a, ones = fps[order], ones[order]
    for s in range(0, len(a), tile):
        left, top = a[s : s + tile], ones[min(s + tile, len(a)) - 1]
        for t in range(s, len(a), tile):
            if ones[t] - top > radius:
                break  # sorted: this tile and all after it differ by more bits
            near = np.bitwise_count(left[:, None] ^ a[None, t : t + tile]) <= radius
            i, j = np.nonzero(np.triu(near, 1) if s == t else near)
            if len(i):
                yield order[i + s], order[j + t]


def links(classes: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(a, b) of representatives: a spanning forest, task by task, of all pairs of classes within the radius.

    ``classes`` has fp and rep, each fp once.
    """
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(n)]
    dealt = classes.select("fp", "rep", F.posexplode(F.array(*block)).alias("block", "value"))
    dealt = parted(dealt, ["block", "value"], "fp", part)
    width = 64 // n + 1
    key = F.col("block").cast("long") * (1 << width) + F.col("value")
    dealt = dealt.select(key.alias("bucket"), "pair", "fp", "rep")
    dealt = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, ["fp", "rep"]):
            fps, reps = rows[:, 0].copy(), rows[:, 1]
            if len(fps) > 1:
                forest = Forest(len(fps))
                out: list[tuple[int, int]] = []
                for i, j in tile_pairs(fps.view(np.uint64), radius):
                    out += [(x, y) for x, y in zip(i.tolist(), j.tolist()) if forest.join(x, y)]
                if out:
                    ends = reps[np.array(out)]
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def parted(dealt: DataFrame, keys: list[str], by: str, part: int) -> DataFrame:
    """The rows with a pair of parts each: rows of buckets (``keys``) of over ``part`` rows are cut by a hash and repeated."""
    # Parts of large buckets only; their number is that of classes over `part`, and they are joined, never collected.
    large = dealt.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > part)
    large = cut(large.select(*keys, F.ceil(F.col("n") / part).cast("int").alias("parts")))
    if large.isEmpty():
        return dealt.withColumn("pair", F.lit(0).cast("long"))
    columns = dealt.columns
    own = F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = dealt.join(large, keys, "left").withColumn("own", own)
    pair = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = dealt.select("*", pair.alias("other"))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    return dealt.select(*columns, (low * (1 << 31) + high).alias("pair"))


def _buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[np.ndarray]:
    """The columns as one matrix, one (bucket, pair) of a sorted partition after the other."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "pair", *columns)], axis=1)
        if not len(rows):
            continue
        if held and (held[-1][-1, :2] != rows[0, :2]).any():
            done = np.concatenate(held)
            held = []
            yield done[:, 2:]
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        pieces = np.split(rows, cuts)
        held.append(pieces[0])
        for piece in pieces[1:]:
            done = np.concatenate(held)
            held = [piece]
            yield done[:, 2:]
    if held:
        yield np.concatenate(held)[:, 2:]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id per row: the smallest id that links of at most ``radius`` bits reach."""
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Nodes are fingerprints, so that classes without an id connect others.
    found = connected(links(classes.select("fp", F.col("fp").alias("rep")), radius))
    classes = classes.join(found, classes.fp == found.node, "left")
    classes = cut(classes.select("fp", "least", F.coalesce("label", "fp").alias("label")))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "label").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits as 64-bit words: those of the hashes, and of the hashes mixed again; each set if in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        h = hashes[i : i + BLOCK]
        words = np.stack([h, *(splitmix(h ^ splitmix(np.array([k], np.uint64))) for k in range(1, BITS // 64))], axis=1)
        counts += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


WORDS = [f"f{k}" for k in range(BITS // 64)]


def sketches(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, digest, n, f0 ...) per row: a digest of the set of shingles, its size, and its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            digests, sizes = [], np.zeros(len(texts), np.int64)
            fps = np.zeros((len(texts), len(WORDS)), np.uint64)
            for i, text in enumerate(texts):
                h = np.unique(shingle_hashes(text, CORPUS_SHINGLE))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes[i] = len(h)
                fps[i] = wide_fingerprint(h)
            columns = [batch.column("uid"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes)]
            columns += [pa.array(fps[:, k].view(np.int64)) for k in range(len(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "digest", "n", *WORDS])

    words = ", ".join(f"{w} long" for w in WORDS)
    return rows.select("uid", "doc_id", "text").mapInArrow(run, f"uid long, doc_id long, digest binary, n long, {words}")


def bands(count: int) -> np.ndarray:
    """Positions of the bits of each band, for so many classes."""
    rows = max(ROWS, (count // CROWD).bit_length())
    n = BANDS if rows == ROWS else math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** rows)))
    found: list[np.ndarray] = []
    while len(found) < n:
        order = np.random.default_rng(len(found)).permutation(BITS) if found else np.arange(BITS)
        found += list(order[: BITS // rows * rows].reshape(-1, rows))
    return np.stack(found[:n])


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, far): a spanning forest, bucket by bucket, of the pairs of representatives whose fingerprints are near.

    ``classes`` has rep, n and the words of the fingerprint, each rep once.
    """
    where = bands(classes.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(where.shape[1])
        base = np.arange(len(where)) << where.shape[1]
        for batch in batches:
            words = np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            found = base + np.stack([bits[:, at] @ weights for at in where], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], [*columns, "buckets"])

    columns = ["rep", "n", *WORDS]
    schema = ", ".join(f"{c} long" for c in columns)
    dealt = classes.select(*columns).mapInArrow(keys, f"{schema}, buckets array<long>")
    dealt = parted(dealt.select(*columns, F.explode("buckets").alias("bucket")), ["bucket"], "rep", WIDE_PART)
    dealt = dealt.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, columns):
            rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
            found = chains(rows[:, 2:].copy().view(np.uint64), rows[:, 1], least)
            if len(found):
                ends = np.sort(rows[:, 0][found[:, :2]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(found[:, 2])], ["a", "b", "far"])

    return dealt.mapInArrow(run, "a long, b long, far long")


def chains(fps: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """(i, j, bits) of a spanning forest of all near pairs of positions; ``sizes`` ascend. A row takes the nearest of each tree."""
    words = np.ascontiguousarray(fps.T)
    reach = np.searchsorted(sizes, sizes / least + 1e-6, side="right")
    limit = np.where(sizes < 5, NEAR_SMALL, NEAR).astype(np.uint16)
    tree = np.arange(len(fps))
    out = []
    for s in range(0, len(fps), LEFT):
        e = min(s + LEFT, len(fps))
        for t in range(s, reach[e - 1], RIGHT):
            u = min(t + RIGHT, reach[e - 1])
            far = np.zeros((e - s, u - t), np.uint16)
            for w in words:
                far += np.bitwise_count(w[s:e, None] ^ w[None, t:u])
            near = far <= limit[s:e, None]
            if t < e:
                near &= np.arange(t, u) > np.arange(s, e)[:, None]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                j = np.flatnonzero(near[i])
                j = j[(t + j < reach[s + i]) & (tree[t + j] != tree[s + i])]
                if len(j):
                    j = j[np.argsort(far[i, j], kind="stable")]
                    met, first = np.unique(tree[t + j], return_index=True)
                    out += [(s + i, t + x, far[i, x]) for x in j[first].tolist()]
                    tree[np.isin(tree, met)] = tree[s + i]
    return np.array(out, np.int64).reshape(-1, 3)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, shingles) of rows of uid and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            sets = [np.unique(shingle_hashes(t, CORPUS_SHINGLE)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("uid", "text").mapInArrow(run, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("k"), (F.size("x") + F.size("y")).alias("both"))
    return cut(counted.where(F.col("k") >= least * (F.col("both") - F.col("k")) - 1e-9).select("a", "b"))


def tiled(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): a spanning forest, task by task, of the pairs of a chain's members that have the similarity.

    ``left`` has chain, rep, label, and the chain's members and weight; members of one label are connected already.
    """
    parts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    dealt = left.select("chain", "rep", "label", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("own"))
    dealt = dealt.join(sets, dealt.rep == sets.node).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    dealt = dealt.select("chain", (low * (1 << 31) + high).alias("pair"), "rep", "label", "shingles")
    dealt = dealt.repartition("chain", "pair").sortWithinPartitions("chain", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, labels, shingles in _tiles(batches):
            if len(reps) > 1 and (labels != labels[0]).any():
                ends = _forest(reps, labels, shingles, least)
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Representatives, labels and sets, one (chain, pair) of a sorted partition after the other."""
    key, reps, labels, held = None, [], [], []
    for batch in batches:
        ends = [batch.column(c).to_numpy() for c in ("chain", "pair", "rep", "label")]
        lists = batch.column("shingles")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, (chain, pair, rep, label) in enumerate(zip(*(e.tolist() for e in ends))):
            if key is not None and key != (chain, pair):
                yield np.array(reps), np.array(labels), held
                reps, labels, held = [], [], []
            key = chain, pair
            reps.append(rep)
            labels.append(label)
            held.append(flat[offsets[i] : offsets[i + 1]].copy())
    if key is not None:
        yield np.array(reps), np.array(labels), held


def _forest(reps: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Links between members of different labels whose sets have the similarity, less those that close a ring."""
    sizes = np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one member alone is in no intersection
    rank = np.cumsum(count > 1) - 1
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # exact: counts are below 2 ** 24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T
    near = common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    i, j = np.nonzero(np.triu(near & (labels[:, None] != labels[None, :]), 1))
    forest = Forest(len(sets))
    kept = [(x, y) for x, y in zip(i.tolist(), j.tolist()) if forest.join(x, y)]
    return reps[np.array(kept, np.int64).reshape(-1, 2)]


def similar_components(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """uid, doc_id and label of rows of uid, doc_id and text: the smallest uid that links of the similarity reach."""
    bound_batches(rows.sparkSession)
    seen = store(sketches(rows), "sketches")
    alike = [F.first(c).alias(c) for c in ("n", *WORDS)]
    classes = cut(seen.groupBy("digest").agg(F.min("uid").alias("rep"), *alike))
    near = cut(candidates(classes, least).distinct())
    chained = cut(connected(near))
    ends = chained.select(F.col("node").alias("uid"))
    sets = store(shingle_sets(rows.join(ends, "uid", "left_semi")), "shingles")
    # Each member of a chain against its nearest and against the chain's first.
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    nearest = both.groupBy("a").agg(F.min(F.struct("far", "b"))["b"].alias("b"))
    pairs = nearest.unionByName(chained.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))
    linked = similar(cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), sets, least)
    found = connected(linked)
    # Members of one chain that are not connected yet; of two members the only pair has been verified.
    left = chained.select(F.col("node").alias("rep"), F.col("label").alias("chain")).join(classes.select("rep", "n"), "rep")
    left = cut(left.join(found, left.rep == found.node, "left").select("chain", "rep", "n", F.coalesce("label", "rep").alias("label")))
    mixed = left.groupBy("chain").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.sum("n").alias("weight"))
    mixed = mixed.where("low < high and members > 2").select("chain", "members", "weight")
    more = cut(tiled(left.join(mixed, "chain"), sets, least))
    if not more.isEmpty():
        found = connected(linked.unionByName(more))
    classes = classes.join(found, classes.rep == found.node, "left").select("digest", F.coalesce("label", "rep").alias("label"))
    return seen.select("uid", "doc_id", "digest").join(classes, "digest").select("uid", "doc_id", "label")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, that with the smallest id, of each component of rows that are near duplicates.

    Rows are told apart by a key of their own: an id that is null or repeated neither drops nor saves a row.
    """
    columns = docs.columns  # kept apart in one struct, so that their names clash with none here
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.monotonically_increasing_id().alias("uid"))
    kept = store(whole, "keyed")
    rows = kept.select("uid", F.col("row").getField(id_col).cast("long").alias("doc_id"), F.col("row").getField(text_col).cast("string").alias("text"))
    labelled = cut(similar_components(rows))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    best = labelled.groupBy("label").agg(F.min(order)["uid"].alias("best"))
    dropped = labelled.join(best, "label").where("uid <> best").select("uid")
    left = kept.join(dropped, "uid", "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
