import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality, toxicity
from lodestrata.llm.common import id_bucket
from lodestrata.llm.samples import labelled

STEMS = ["river", "stone", "window", "garden", "bright", "carry", "follow", "under", "market", "silver", "letter", "mountain"]
BAD = ["blorgit", "snarkle", "vexomil"]


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    rnd = random.Random(10)
    docs, labels = [], []
    for i in range(900):
        words = [rnd.choice(STEMS) + rnd.choice(["", "s", "ing", "ly"]) for _ in range(rnd.randint(8, 60))]
        toxic, junk = i % 6 == 0, i % 5 == 1
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(BAD))
        text = " ".join(words)
        if junk:
            text = rnd.choice([text.upper().replace(" ", "!! "), " ".join([words[0]] * 40), " | ".join(words)])
        docs.append((i, text))
        labels.append((i, 0 if junk else 1, int(toxic)))
    labels += [(None, 1, 1), (5000, 1, 1), (7, None, None), (0, 0, 0)]
    return make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1:] for r in labels[:900]}


def test_quality_on_held_out(corpus):
    docs, labels, truth = corpus
    sample, totals = labelled(docs, labels, "quality", id_bucket(F.col("doc_id"), 5) != 0, (300, 300))
    found = quality.score(docs, quality.fit(sample, totals), id_bucket(F.col("doc_id"), 5) == 0).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 900 and len(held) > 100
    assert sum(r.predicted == truth[r.doc_id][0] for r in held) / len(held) > 0.95


def test_toxicity_on_held_out(corpus):
    docs, labels, truth = corpus
    known = id_bucket(F.col("doc_id"), 4) != 2
    found = toxicity.score(docs, toxicity.model_of(docs, labels, known), id_bucket(F.col("doc_id"), 4) == 2).collect()
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) / len(held) > 0.95
    kept = toxicity.remove_toxic(docs, labels, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}


def test_odd_texts(corpus, make_docs, odd_rows):
    docs, labels, _ = corpus
    odd = make_docs(odd_rows)
    model = toxicity.model_of(docs, labels, F.lit(True))
    for found in (toxicity.score(odd, model, F.lit(None).cast("boolean")), quality.score(odd, quality.fit(*labelled(docs, labels, "quality", F.lit(True), (50, 50))), F.lit(True))):
        rows = found.collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


def test_nothing_to_learn_from(spark, make_docs):
    docs, labels = make_docs([(1, "some text"), (2, "more")]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.model_of(docs, labels, F.lit(True)), F.lit(False)).collect()] == [0.0, 0.0]
    assert all(r.score > 0.9 for r in quality.score(docs, quality.fit(*labelled(docs, labels, "quality", F.lit(True), (5, 5))), F.lit(False)).collect())
    none = labels.limit(0)
    assert all(r.score == 0.5 for r in quality.score(docs, quality.fit(*labelled(docs, none, "quality", F.lit(True), (5, 5))), F.lit(False)).collect())
    assert toxicity.remove_toxic(make_docs([]), none, F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def wide(spark, make_docs):
    """Two in five documents are toxic, each by one of many words."""
    rnd = random.Random(11)
    bad = ["".join(rnd.choice("bcdfghjklmnpqrstvwxz") + rnd.choice("aeiou") for _ in range(5)) for _ in range(160)]
    docs, labels = [], []
    for i in range(1000):
        w = [rnd.choice(STEMS) + rnd.choice(["", "s", "ing", "ly"]) for _ in range(rnd.randint(8, 60))]
        if i % 5 < 2:
            w.insert(rnd.randint(0, len(w)), bad[i // 5 * 2 % 160 + i % 5])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 < 2)))
    return make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_wide_toxic_vocabulary_rejects_toxic_documents_alone(wide):
    docs, labels = wide
    kept = {r.doc_id for r in toxicity.remove_toxic(docs, labels, id_bucket(F.col("doc_id"), 4) != 2).collect()}
    clean, toxic = {i for i in range(1000) if i % 5 > 1}, {i for i in range(1000) if i % 5 < 2}
    assert len(clean & kept) > 0.98 * len(clean) and len(toxic & kept) < 0.5 * len(toxic)


def test_a_prior_alone_rejects_nothing(spark, make_docs):
    docs = make_docs([(1, "some text"), (2, "more of it"), (3, "and more")])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.remove_toxic(docs, labels, F.lit(True)).count() == 3


def test_features_of_long_texts_do_not_depend_on_the_cut(monkeypatch):
    rnd = random.Random(13)
    text = " ".join(rnd.choice(["aa", "aa", "b", "stone", "\u00e9\u00e8", "x" * 90]) for _ in range(600))

    def counted():
        return np.bincount(np.concatenate(list(quality.features(text))), minlength=1 << quality.BITS)

    whole = counted()
    for span in (50, 64, 333):
        monkeypatch.setattr(quality, "SPAN", span)
        assert (counted() == whole).all()


def test_quality_scores_against_plain_python(corpus, make_docs, odd_rows):
    docs, labels, _ = corpus
    logits = quality.fit(*labelled(docs, labels, "quality", F.lit(True), (100, 100)))
    rows = odd_rows + [(20, "stone " * 60_000), (21, "a!! b!! a!! b")]
    found = sorted((r.score, r.predicted) for r in quality.score(make_docs(rows), logits, F.lit(True)).collect())

    def plain(text):
        grams = np.concatenate(list(quality.features(text or "")))
        p = 1 / (1 + np.exp(-sum(float(logits[g]) for g in grams) / len(grams)))
        return p, int(p >= 0.3)

    expected = sorted(plain(t) for _, t in rows)
    assert [f[0] for f in found] == pytest.approx([float(e[0]) for e in expected], abs=1e-6)
    assert [f[1] for f in found] == [e[1] for e in expected]


def test_toxicity_scores_against_plain_python(corpus, make_docs, odd_rows):
    docs, labels, _ = corpus
    model = toxicity.model_of(docs, labels, F.lit(True))
    rows = odd_rows + [(20, "stone blorgit " * 30_000), (21, "river snarkle river")]
    found = sorted(r.score for r in toxicity.score(make_docs(rows), model, F.lit(True)).collect())
    distances = toxicity.Distances(model)

    def plain(text):
        d = [max((len(distances.ordinary(distances.lead + w + toxicity.TAIL)) - len(distances.toxic(distances.lead + w + toxicity.TAIL)), w) for w in toxicity.windows(x)) for x in toxicity.words(text or "")]
        top = sorted((s for s, _ in d), reverse=True)[:3]
        if not top:
            total = model.weights[-1]
        else:
            halved = sum(distances.of(x)[1] for x in toxicity.words(text))
            f = [top[0], sum(top) / 3, *(math.log1p(sum(s >= k for s, _ in d)) for k in toxicity.STEPS), math.log1p(len(d)), math.log1p(halved)]
            total = sum(a * b for a, b in zip(f, model.weights)) + model.weights[-1]
        if not top or top[0] < 1:
            total = min(total, toxicity.LIMIT - 1e-6)
        return 1 / (1 + math.exp(-total))

    assert found == pytest.approx(sorted(plain(t) for _, t in rows), abs=1e-9)
