import random

import numpy as np

from lodestrata.llm import decontaminate as d


def brute(docs, items):
    found = set()
    for doc_id, text in docs:
        own = set(d.shingles(text or "").tolist())
        for item_id, item in items:
            s = set(d.shingles(item or "").tolist())
            if s and len(s & own) >= 0.8 * len(s):
                found.add((doc_id, item_id, len(s), len(s & own)))
    return found


def test_against_brute_force(spark, make_docs, odd_rows):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(4000)]

    def prose(n):
        return [rnd.choice(words) for _ in range(n)]

    items = [(i, " ".join(prose(n))) for i, n in enumerate([3, 5, 8, 15, 16, 17, 30, 59, 60, 130, 500] * 3)] + [(90, None), (91, ""), (None, "null id item with seven words")]
    docs = list(odd_rows)
    for k, (_, item) in enumerate(items[:33]):
        own = item.split()
        docs.append((100 + k, " ".join(prose(rnd.choice([0, 30, 3000])) + own + prose(rnd.choice([0, 20, 900])))))
        docs.append((200 + k, " ".join(prose(50) + own[: max(1, int(len(own) * rnd.choice([0.5, 0.95])))] + prose(50))))
        docs.append((300 + k, item.upper().replace(" ", ", ")))
    docs.append((400, "null id item with seven words"))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    found = d.contamination(make_docs(docs), bench).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in found} == brute(docs, items)
    kept = d.decontaminate(make_docs(docs), bench)
    bad = {r.doc_id for r in found}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(make_docs([(1, "a b c d e f")]), bench).count() == 0
    assert d.contamination(make_docs([]), bench).count() == 0


def test_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 2)
    items = [(i, f"item number {i} has some words {i} of text") for i in range(7)]
    docs = [(i, f"before {t} after") for i, t in items]
    assert {(r.doc_id, r.item_id) for r in d.contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()} == {(i, i) for i in range(7)}


def test_permutations_differ():
    h = np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(set(d.permuted(h, d.salts()).argmin(axis=1).tolist())) > 50


def test_rows_are_judged_one_by_one(spark, make_docs):
    leak = "the item has these seven words inside"
    docs = [(None, f"before {leak} after"), (None, "a clean text without an id"), (5, f"{leak} again"), (5, "a clean text with the same id"), (6, "more text")]
    kept = d.decontaminate(make_docs(docs), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == sorted([docs[1][1], docs[3][1], docs[4][1]])


def test_parts_do_not_change_candidates(monkeypatch):
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (6, 12, 40, 150, 700, 2500)]
    filler = [rnd.choice(vocabulary) for _ in range(6000)]
    documents = [" ".join(filler[:at] + item.split() + filler[at:]) for item in items for at in (0, 61, 1500, 6000)]
    block = d.Items(list(range(len(items))), items)
    whole = [block.candidates(d.shingles(x)) for x in documents]
    for span in (16, 64, 1024):
        monkeypatch.setattr(d, "SPAN", span)
        assert [block.candidates(d.shingles(x)) for x in documents] == whole
    assert all(k // 4 in found for k, found in enumerate(whole))
