"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 4 characters in ``2 ** BITS`` buckets for each language. It draws about
``SAMPLE`` texts of each language (all, if fewer), by a hash of id and text, and counts them where they lie: tasks return
sparse (language, bucket, count) rows that a grouped sum merges, so only the bounded count matrix reaches the driver.
``LANGUAGES`` bounds that matrix and with it the broadcast of log-probabilities (256 KB a language at the defaults).

A text is scored whole: the rows of the log-probability matrix at its buckets are summed, for the texts of a batch at once
and in bounded parts: the product of sparse counts with the matrix. The score is the posterior of the language predicted.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing was
learned; ties go to the first language in order of code points; a null id is neither learned from nor held out; repeated
rows are counted and scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, each_text, id_bucket, table
from .ngrams import char_grams, code_points, parts

BITS = 16
SIZES = (1, 2, 3, 4)
#: Texts of each language that are learned from, about; languages, at most.
SAMPLE = 4000
LANGUAGES = 1000
DRAWS = 1_000_000_007
#: Log-probabilities that are gathered at once.
GATHER = 1 << 21
ALPHA = 0.5
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def counts(text: str) -> np.ndarray:
    """Counts of the text's n-grams by bucket; words are bounded by a blank, white space is one blank."""
    text = f" {' '.join(text.lower().split())} "
    total = np.zeros(1 << BITS, np.int64)
    overlap = SIZES[-1] - 1
    for i, part in enumerate(parts(text, overlap)):
        grams = char_grams(code_points(part), SIZES, BITS)
        total += np.bincount(grams, minlength=1 << BITS)
        if i:  # the shorter n-grams within the overlap have been counted with the part before
            total -= np.bincount(char_grams(code_points(part[:overlap]), SIZES, BITS), minlength=1 << BITS)
    return total


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log priors and log-probabilities (bucket, language), from columns doc_id, text, lang."""
    spark = labelled.sparkSession
    bound_batches(spark)
    known = labelled.where("lang is not null and text is not null")
    totals = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not totals:
        return [], np.zeros(0), np.zeros((1 << BITS, 0), np.float32)
    langs = [r[0] for r in totals]
    n = np.array([r[1] for r in totals], float)
    # A share of the hash range that yields about SAMPLE rows of each language: no sort, and no task that holds a language.
    share = {lang: min(1.0, SAMPLE / k) for lang, k in zip(langs, n)}
    limits = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(DRAWS))
    chosen = known.where(drawn < F.element_at(limits, F.col("lang")) * DRAWS)
    code = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch, texts in each_text(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                if has_letter(text):
                    k = code[lang]
                    total[k] = total.get(k, 0) + counts(text)
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["k", "bucket", "n"])

    rows = chosen.select("text", "lang").mapInArrow(count, "k int, bucket int, n long")
    summed = rows.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full((1 << BITS, len(langs)), ALPHA)
    k, bucket, c = (summed.column(x).to_numpy() for x in ("k", "bucket", "n"))
    matrix[bucket, k] += c
    return langs, np.log(n / n.sum()), np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent: Broadcast = spark.sparkContext.broadcast(model)
    held = F.coalesce(id_bucket(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = sent.value
        for batch, texts in each_text(batches, "text"):
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            total = log_sums([texts[i] for i in known], logp) + prior
            weight = np.exp(total - total.max(axis=1, keepdims=True)) if known else total
            for i, w, top in zip(known, weight, weight.argmax(axis=1) if known else []):
                best[i], score[i] = langs[top], w[top] / w.sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, PREDICTED)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in bounded parts; see :func:`counts`."""
    text = f" {' '.join(text.lower().split())} "
    overlap = SIZES[-1] - 1
    for i, part in enumerate(parts(text, overlap)):
        codes = code_points(part)
        if not i:
            yield char_grams(codes, SIZES, BITS)
        else:
            for size in SIZES:
                yield char_grams(codes, (size,), BITS)[max(0, overlap - size + 1) :]


def log_sums(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """(text, language): sums of the log-probabilities of the texts' n-grams."""
    out = np.zeros((len(texts), logp.shape[1]))
    most = max(1, GATHER // max(1, logp.shape[1]))
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def add() -> None:
        starts = np.cumsum([0, *map(len, held[:-1])])
        np.add.at(out, rows, np.add.reduceat(logp[np.concatenate(held)], starts, axis=0, dtype=np.float64))

    for i, text in enumerate(texts):
        for part in grams(text):
            for at in range(0, len(part), most):
                piece = part[at : at + most]
                if held and size + len(piece) > most:
                    add()
                    held, rows, size = [], [], 0
                held.append(piece)
                rows.append(i)
                size += len(piece)
    if held:
        add()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, by a model of those whose id's remainder is not 1."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where(id_bucket(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")
    return predict(docs, learn(known))
