"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter.

A window is a word with a blank on each side, lower-cased (a word of more than ``LONGEST`` bytes gives several windows
that overlap). Its distance is its compressed length with the ordinary dictionary less that with the toxic one. Both
dictionaries begin with what is trained on ordinary text, and the toxic one ends in what is trained on toxic text; so an
ordinary window is compressed about alike by both, and a toxic one is shorter by what the toxic content saves. A fixed lead and tail are added to each
window: without the lead zstandard stores short blocks as they are, and its match finders never start a match in the
last eight bytes. The same window always has the same distance, so each worker keeps a bounded table of distances.

Training, from at most ``SAMPLE`` documents of each label (see :mod:`.samples`), near copies among them once:

1. The ordinary dictionary is trained by zstandard on stretches of ordinary texts.
2. The toxic dictionary is trained by zstandard on the over-represented windows of toxic texts, one sample per text. A
   window is over-represented if the word, or one of its beginnings, is in toxic documents ``RATIO`` times as often as in
   ordinary ones with a log-likelihood gain of ``GAIN`` or more (at most ``UNITS`` such units, those of the highest gain;
   if there are none, the ``FEW`` words of the highest gain that no ordinary document has). On whole toxic texts zstandard
   picks what is frequent in any text, and the distances tell next to nothing.
3. The calibration third of the sample, which steps 1 and 2 have not seen, gives a logistic curve over a text's
   largest distance, the mean of its three largest, and the logarithms of the number of its words, of those with a
   distance of each of ``STEPS`` or more, and of those of which the toxic dictionary saves half or more; labels weigh by their shares among all labelled ids. It also picks the segment
   length of the toxic dictionary, of ``SEGMENTS``, by its likelihood (or all windows as they are, where they fit). If that third lacks a label, the whole sample calibrates.

Defined results: null text is empty; a text without words has distance zero; with nothing to learn from scores are
the share of toxic labels, or 0; a null id is neither learned from nor held out; repeated rows are scored alike; an
empty table gives an empty result; further columns are ignored. Such a share alone rejects no document in :func:`remove_toxic`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, each_text, id_bucket, splitmix, table
from .samples import labelled
from .simhash import shingle_hashes

#: Ordinary and toxic documents that are learned from, at most.
SAMPLE = (4000, 2000)
FOLDS = 3
#: Sizes of the dictionaries; together they fit the search tables of the compressor.
ORDINARY_BYTES = 4096
TOXIC_BYTES = 3072
#: Segment and match lengths of zstandard's training on over-represented windows, and bytes of these from one text.
SEGMENTS = (24, 50)
MATCH = 6
TEXT_BYTES = 4096
#: Over-represented units, at most; words that stand in for them where there are none; documents that have one, at least.
UNITS = 2000
FEW = 200
LEAST = 3
RATIO = 4.0
GAIN = 7.0
STEPS = (3, 4, 5)
LONGEST = 48
LEAD = 64
TAIL = bytes(12)
#: Distances that a worker keeps.
KEPT = 200_000
THRESHOLD = 0.3
LIMIT = math.log(THRESHOLD / (1 - THRESHOLD))
WORD = re.compile(rb"[^\s!-/:-@\[-`{-~]+")
FEATURES = ("top", "three", *(f"over{k}" for k in STEPS), "size", "halved")
SCORED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """Dictionary contents, the features' weights, and the score where nothing was learned."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None
    prior: float = 0.0


def words(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def windows(word: bytes) -> list[bytes]:
    if len(word) <= LONGEST:
        return [b" %s " % word]
    half = LONGEST // 2
    return [b" %s " % word[i : i + LONGEST] for i in range(0, len(word) - half, half)]


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    """Compression with a dictionary; the binary-tree strategy searches it thoroughly."""
    params = zstandard.ZstdCompressionParameters(
        window_log=15, chain_log=15, hash_log=15, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


class Distances:
    """Distances of words under a model's dictionaries."""

    def __init__(self, model: Model) -> None:
        self.lead = model.ordinary[-LEAD:] + b"\n"  # a line end, so that no match runs from the lead into the window
        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.ordinary + model.toxic)
        self.blank = len(self.ordinary(self.lead + b"  " + TAIL))
        self.kept: dict[bytes, tuple[int, int]] = {}

    def of(self, word: bytes) -> tuple[int, int]:
        """The word's distance, and whether that is half of what the ordinary dictionary takes, or more."""
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = self.kept[word] = max(map(self._of, windows(word)))
        return found

    def _of(self, window: bytes) -> tuple[int, int]:
        framed = self.lead + window + TAIL
        plain = len(self.ordinary(framed))
        saved = plain - len(self.toxic(framed))
        return saved, int(saved >= 2 and 2 * saved >= plain - self.blank)

    def features(self, text: str) -> tuple[float, ...]:
        """A text's largest distance, the mean of its three largest, and logarithms of counts."""
        d = np.array([self.of(w) for w in words(text)], np.int64).reshape(-1, 2)
        if not len(d):
            return (0.0,) * len(FEATURES)
        d, halved = d[:, 0], int(d[:, 1].sum())
        top = np.sort(np.partition(d, -3)[-3:]) if len(d) > 3 else np.sort(d)
        over = (math.log1p(int((d >= k).sum())) for k in STEPS)
        return float(top[-1]), float(top.sum()) / 3, *over, math.log1p(len(d)), math.log1p(halved)


def units_of(word: bytes) -> list[str]:
    """The word, between blanks, and its beginnings of 4 to 9 bytes, after a blank."""
    out = [b" %s " % word[:LONGEST], *(b" %s" % word[:n] for n in range(4, min(len(word), 10)))]
    return [u.decode("utf-8", "ignore") for u in out]


def units(text: str) -> set[str]:
    return {u for w in set(words(text)) for u in units_of(w)}


def _distinct(sample: DataFrame) -> DataFrame:
    """The sample without near copies: of rows with the same minimum over their shingles, the first by hash stays."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            m = np.zeros((len(texts), 3), np.int64)
            for i, text in enumerate(texts):
                h = shingle_hashes(text, 5)
                if len(h):
                    m[i] = [int(splitmix(h + np.uint64(k)).min().astype(np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, m.T.copy())], [*batch.schema.names, "m0", "m1", "m2"])

    rows = sample.mapInArrow(sketch, "label int, h long, text string, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        first = F.min_by(F.struct("label", "h", "text", "m0", "m1", "m2"), F.struct("h", "text"))
        rows = rows.groupBy(F.col("label").alias("l"), F.col(m).alias("m")).agg(first.alias("r")).select("r.*")
    return cut(rows.select("label", "h", "text", F.pmod(F.xxhash64("m0"), F.lit(FOLDS)).cast("int").alias("fold")))


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, toxic, ordinary): in how many documents of each label a unit is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            for label, text in zip(batch.column("label").to_pylist(), texts):
                found = sorted(units(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), label, np.int32))], ["unit", "label"])

    pairs = rows.select("label", "text").mapInArrow(run, "unit string, label int")
    counts = pairs.groupBy("unit").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))
    return cut(counts.where("toxic > 1"))


def _ordinary_content(rows: DataFrame) -> bytes:
    """Content of the dictionary that zstandard trains on stretches of ordinary texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            out = []
            for text in texts:
                b = text.lower().encode("utf-8", "surrogatepass")
                out += [b[int(i) : int(i) + 64] for i in np.linspace(0, max(0, len(b) - 64), 16)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(out, pa.binary())})

    return trained(rows.where("label = 0").select("text").mapInArrow(run, "part binary").collect(), ORDINARY_BYTES).rjust(LEAD, b" ")


def _toxic_contents(rows: DataFrame, chosen: list[str]) -> list[bytes]:
    """Contents of the dictionaries that zstandard trains on the windows of toxic texts that have one of the units."""
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch, texts in each_text(batches, "text"):
            out = []
            for text in texts:
                found = [w for w in words(text) if not known.isdisjoint(units_of(w))]
                drawn = sorted(range(len(found)), key=lambda i: xxhash.xxh64_intdigest(found[i], i))
                size, kept = 0, []
                for i in drawn:  # an even draw of a bounded size, in the order of the text
                    if (size := size + len(found[i]) + 2) > TEXT_BYTES:
                        break
                    kept.append(i)
                out.append(b"".join(b" %s " % found[i][:LONGEST] for i in sorted(kept)))
            yield pa.RecordBatch.from_pydict({"part": pa.array(out, pa.binary())})

    parts = rows.where("label = 1").select("text").mapInArrow(run, "part binary").collect()
    whole = b" %s " % b"  ".join(sorted({w for r in parts for w in bytes(r[0]).split()}))
    # Windows that all fit are a candidate as they are: zstandard passes over what hardly recurs.
    return [trained(parts, TOXIC_BYTES, k=k, d=MATCH) for k in SEGMENTS] + [whole] * (len(whole) <= TOXIC_BYTES)


def trained(parts: list, size: int, **how: int) -> bytes:
    """What zstandard trains on the parts, in the order of a hash; where they are too few to train on, their end."""
    held = sorted((bytes(r[0]) for r in parts), key=lambda p: (xxhash.xxh64_intdigest(p), p))
    try:
        return zstandard.train_dictionary(size, [p for p in held if len(p) >= 8], **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(held)[-size:]


def _chosen(counts: DataFrame, t: float, o: float) -> list[str]:
    """The over-represented units, from the documents of each label that have them (``t`` and ``o`` in all)."""
    a, b = F.col("toxic").cast("double"), F.col("ordinary").cast("double")
    both = (a + b) / (t + o)

    def fit_to(k: Column, m: float, p: Column) -> Column:
        return k * F.log(F.greatest(p, F.lit(1e-12))) + (m - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    gain = fit_to(a, t, a / t) + fit_to(b, o, b / o) - fit_to(a, t, both) - fit_to(b, o, both)
    ranked = [
        [r[0] for r in counts.where(which).orderBy(gain.desc(), "unit").select("unit").limit(most).collect()]
        for most, which in ((UNITS, (a >= LEAST) & (a / t >= RATIO * (b + 0.5) / o) & (gain >= GAIN)), (FEW, (b == 0) & F.col("unit").endswith(" ")))
    ]
    return ranked[0] or ranked[1]


def fit(sample: DataFrame, totals: list[int]) -> Model:
    """Dictionaries and calibration from (label, h, text)."""
    bound_batches(sample.sparkSession)
    prior = totals[1] / sum(totals) if sum(totals) else 0.0
    rows = _distinct(sample)
    tally = {(r["label"], r["learns"]): r["n"] for r in rows.groupBy("label", (F.col("fold") > 0).alias("learns")).agg(F.count("*").alias("n")).collect()}
    n = {k: tally.get((k, True), 0) for k in (0, 1)}
    if not n[0] or not n[1]:
        return Model(b" " * LEAD, b"", None, prior)
    part = rows.where("fold > 0")
    chosen = _chosen(_unit_counts(part), float(n[1]), float(n[0]))
    if not chosen:
        return Model(b" " * LEAD, b"", None, prior)
    unseen = all(tally.get((k, False)) for k in (0, 1))
    calibrates = cut(rows.where("fold = 0" if unseen else "true").select("label", "h", "text"))
    ordinary, best = _ordinary_content(part), None
    for toxic in _toxic_contents(part, chosen):
        model = Model(ordinary, toxic, (0.0,) * (len(FEATURES) + 1))
        seen = _features(calibrates, model, "label int, h long").orderBy("h", "label", *FEATURES).collect()
        loss, weights = _logistic(np.array([(r.label, *(r[f] for f in FEATURES)) for r in seen], float), totals)
        if best is None or loss < best[0]:
            best = loss, Model(ordinary, toxic, weights, prior)
    return best[1]


def _logistic(rows: np.ndarray, totals: list[int]) -> tuple[float, tuple[float, ...]]:
    """Loss, and weights of the features and a constant, by ridge-damped Newton steps, from rows of both labels."""
    y = rows[:, 0]
    share = np.array([totals[0] / (y == 0).sum(), totals[1] / (y == 1).sum()])
    weight = share[y.astype(int)] / share[y.astype(int)].sum() * len(y)
    x = np.column_stack([rows[:, 1:], np.ones(len(y))])
    damped = np.array([0.1] * len(FEATURES) + [0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (damped * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + damped * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(damped + 1e-6)
        step, part = np.linalg.solve(curve, slope), 1.0
        while loss(w - part * step) > now and part > 1e-6:
            part /= 2
        before, w = now, w - part * step
        now = loss(w)
        if before - now < 1e-9:
            break
    return now / len(y), tuple(float(v) for v in w)


def _features(rows: DataFrame, model: Model, kept: str) -> DataFrame:
    """The kept columns of ``rows``, with the features of each text."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(sent.value)
        for batch, texts in each_text(batches, "text"):
            f = np.array([distances.features(t) for t in texts]).reshape(-1, len(FEATURES))
            own = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *map(pa.array, f.T.copy())], [*(batch.schema.names[i] for i in own), *FEATURES])

    return rows.mapInArrow(run, ", ".join([kept, *(f"{name} double" for name in FEATURES)]))


def score(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    if model.weights is None:
        out = rows.select("doc_id", "held_out", F.lit(float(model.prior)).alias("score"))
    else:
        found = _features(rows, model, "doc_id long, held_out boolean")
        total = sum((F.col(name) * w for name, w in zip(FEATURES, model.weights)), F.lit(model.weights[-1]))
        # A text in which nothing is nearer to the toxic dictionary is not toxic, however common toxic labels are.
        total = F.when(F.col("top") < 1, F.least(total, F.lit(LIMIT - 1e-6))).otherwise(total)
        out = found.select("doc_id", "held_out", (1 / (1 + F.exp(-total))).alias("score"))
    return out.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def model_of(docs: DataFrame, labels: DataFrame, known: Column) -> Model:
    sample, totals = labelled(docs, labels, "toxic", known, SAMPLE)
    return fit(sample, totals)


def remove_toxic(docs: DataFrame, labels: DataFrame, known: Column) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic; all of them where there was nothing to learn from."""
    model = model_of(docs, labels, known)
    if model.weights is None:
        return docs
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(sent.value)
        for batch, texts in each_text(batches, "text"):
            f = np.array([distances.features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array((f @ weights[:-1] + weights[-1] < LIMIT) | (f[:, 0] < 1)))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, by a model of ids whose remainder is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = model_of(docs, labels, id_bucket(F.col("doc_id"), 4) != 2)
    return score(docs, model, id_bucket(F.col("doc_id"), 4) == 2)
