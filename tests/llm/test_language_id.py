import numpy as np
import pytest

from lodestrata.llm import language_id as li

LINES = {"en": "the quick brown fox jumps over the lazy dog and then it goes home", "de": "der schnelle braune fuchs springt \u00fcber den faulen hund und geht nach hause", "fr": "le renard brun saute par dessus le chien paresseux et rentre chez lui"}


@pytest.fixture(scope="module")
def model(make_docs):
    rows = [(i, " ".join(w for w in text.split()[i % 5 :]), lang) for lang, text in LINES.items() for i in range(12)]
    return li.learn(make_docs(rows + [(1, None, "en"), (2, "nothing", None), (3, "12 34", "en")]).select("doc_id", "text", "lang"))


def test_predicts_known_languages(model, make_docs):
    rows = [(10, "the dog goes home"), (11, "der hund geht nach hause"), (12, "le chien rentre chez lui")]
    assert {r.doc_id: r.lang_pred for r in li.predict(make_docs(rows), model).collect()} == {10: "en", 11: "de", 12: "fr"}


def test_odd_texts(model, make_docs, odd_rows):
    found = li.predict(make_docs(odd_rows), model).collect()
    assert len(found) == len(odd_rows)
    assert {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (1, 2, 3)} == {i: ("und", 0.0) for i in (1, 2, 3)}
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)


def test_nothing_learned_and_empty_tables(make_docs):
    empty = li.learn(make_docs([]).select("doc_id", "text", "lang"))
    assert li.predict(make_docs([(1, "word")]), empty).first().lang_pred == "und"
    assert li.predict(make_docs([]), empty).count() == 0


def test_counts_do_not_depend_on_parts():
    text = "abc def \u00e9" * 1000
    whole = li.counts(text)
    span, li.parts.__defaults__ = li.parts.__defaults__, (100,)
    try:
        assert (li.counts(text) == whole).all()
    finally:
        li.parts.__defaults__ = span


def test_scores_against_plain_python(model, make_docs, odd_rows):
    langs, prior, logp = model
    rows = odd_rows + [(20, "le chien brun " * 30_000), (21, "x"), (22, "the der le")]
    found = sorted((r.lang_pred, r.score) for r in li.predict(make_docs(rows), model).collect())

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total = prior + np.array([sum(float(n) * float(logp[b, k]) for b, n in enumerate(li.counts(text)) if n) for k in range(len(langs))])
        p = np.exp(total - total.max())
        return langs[int(total.argmax())], float(p.max() / p.sum())

    expected = sorted(plain(t) for _, t in rows)
    assert [f[0] for f in found] == [e[0] for e in expected]
    assert [f[1] for f in found] == pytest.approx([e[1] for e in expected], abs=1e-6)


def test_parts_and_gathers_do_not_change_sums(model, monkeypatch):
    _, _, logp = model
    texts = ["abc def é " * 300, "", "x", "le renard brun " * 50]
    whole = li.log_sums(texts, logp)
    monkeypatch.setattr(li, "GATHER", 600)
    monkeypatch.setattr(li.parts, "__defaults__", (100,))
    assert li.log_sums(texts, logp) == pytest.approx(whole)
