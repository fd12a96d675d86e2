"""Quality classifier: subword embeddings, averaged per document, with a softmax output.

A document's features are its words, the character n-grams of 3 and 4, and for each word whether it repeats one of the
two before it, hashed into ``2 ** BITS`` buckets, and one end mark. Each bucket has a vector of ``WIDTH``; a document is the mean of its features' vectors, and a softmax layer
gives the probabilities of labels 0 and 1. Vectors and layer are trained together by stochastic gradient descent in
numpy on the driver, over at most ``SAMPLE`` documents of each label (see :mod:`.samples`); their features are counted on
the executors, so the driver gets sparse counts, of at most ``2 ** BITS`` buckets a document, and no texts.

Scoring uses that the layer is linear in the mean: the difference of both logits is the mean of one number per bucket,
which is all that is broadcast (0.5 MB).

Defined results: null text is empty; an empty text has the end mark alone; with documents of fewer than two labels to
learn from every score is the share of label 1, or 0.5; a null id is neither learned from nor held out; repeated rows are
scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, each_text, id_bucket, table
from .ngrams import SPAN, char_grams, code_points, mixed, parts
from .samples import labelled

BITS = 17
WIDTH = 16
SIZES = (3, 4)
#: Documents of each label that are learned from, at most.
SAMPLE = 2000
EPOCHS = 5
RATE = 20.0
THRESHOLD = 0.3
SCORED = "doc_id long, held_out boolean, score double, predicted int"
_POWERS = np.cumprod(np.full(64, 0x01000193, np.uint64)).astype(np.uint32)
_MASK = np.uint32((1 << BITS) - 1)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """32-bit hash of each run of code points above 32."""
    solid = codes > 32
    starts = np.flatnonzero(solid & np.append(True, ~solid[:-1])) if len(codes) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    kept = codes[solid]
    counts = np.add.reduceat(solid, starts, dtype=np.int64)
    first = np.append(0, np.cumsum(counts)[:-1])
    place = np.arange(len(kept)) - np.repeat(first, counts)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat((kept + np.uint32(7)) * _POWERS[place & 63], first).astype(np.uint32))


def repeats(words: np.ndarray) -> np.ndarray:
    """Bucket of each word's pattern of agreement with the two words before it."""
    pattern = np.ones(len(words), np.uint32)
    pattern[1:] += words[1:] == words[:-1]
    pattern[2:] += 2 * (words[2:] == words[:-2]).astype(np.uint32)
    return mixed(pattern) & _MASK


def word_parts(text: str, span: int = SPAN) -> Iterator[str]:
    """The text in parts of about ``span`` characters, cut at white space only: a word is never cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + span)
        while end < len(text) and ord(text[end]) > 32:
            end += 1
        yield text[at:end]
        at = end


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, in bounded parts that give the same features as the whole."""
    overlap = SIZES[-1] - 1
    for i, part in enumerate(parts(text, overlap, SPAN)):
        codes = code_points(part)
        if not i:
            yield char_grams(codes, SIZES, BITS)
        else:  # without the shorter n-grams within the overlap: they came with the part before
            for size in SIZES:
                yield char_grams(codes, (size,), BITS)[max(0, overlap - size + 1) :]
    before = np.zeros(0, np.uint32)
    for part in word_parts(text, SPAN):
        words = word_hashes(code_points(part))
        yield words & _MASK
        yield repeats(np.concatenate([before, words]))[len(before) :]
        before = np.concatenate([before, words])[-2:]
    yield np.zeros(1, np.uint32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bucket vectors and output layer from (label, buckets, counts); labels weigh by their shares."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, 2), np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, at, count = rows[i]
            share = (count / count.sum()).astype(np.float32)
            mean = share @ vectors[at]
            e = np.exp((z := mean @ layer) - z.max())
            error = (e / e.sum()).astype(np.float32)
            error[label] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            back = layer @ error
            layer -= rate * np.float32(0.05) * np.outer(mean, error)
            vectors[at] -= rate * share[:, None] * back[None, :]
            step += 1
    return vectors, layer


def fit(sample: DataFrame, totals: list[int]) -> np.ndarray:
    """One logit per bucket, from (label, h, text)."""
    bound_batches(sample.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches, "text"):
            at, n = [], []
            for text in texts:
                total = np.zeros(1 << BITS, np.int64)
                for part in features(text):
                    total += np.bincount(part, minlength=1 << BITS)
                at.append(np.flatnonzero(total).astype(np.int32))
                n.append(total[at[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["label", "h", "at", "n"])

    counted = sample.mapInArrow(count, "label int, h long, at array<int>, n array<float>").toArrow()
    columns = (counted.column(c) for c in ("label", "h", "at", "n"))
    rows = [(label.as_py(), h.as_py(), a.values.to_numpy(), n.values.to_numpy()) for label, h, a, n in zip(*columns)]
    rows.sort(key=lambda r: (r[1], r[0], len(r[2]), r[3].sum()))  # the order in which tasks ended must not matter
    if len({r[0] for r in rows}) < 2:
        share = totals[1] / sum(totals) if sum(totals) else 0.5
        return np.full(1 << BITS, np.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.float32)
    vectors, layer = train([(r[0], r[2], r[3]) for r in rows])
    return vectors @ (layer[:, 1] - layer[:, 0])


def score(docs: DataFrame, logits: np.ndarray, held: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(logits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = sent.value
        for batch, texts in each_text(batches, "text"):
            mean = np.zeros(len(texts))
            for i, text in enumerate(texts):
                total, n = 0.0, 0
                for part in features(text):
                    total += float(logits[part].sum(dtype=np.float64))
                    n += len(part)
                mean[i] = total / n
            p = 1 / (1 + np.exp(-np.clip(mean, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, by a model of ids whose remainder is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample, totals = labelled(docs, labels, "quality", id_bucket(F.col("doc_id"), 5) != 0, (SAMPLE, SAMPLE))
    return score(docs, fit(sample, totals), id_bucket(F.col("doc_id"), 5) == 0)
