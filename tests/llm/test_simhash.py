import random
import re

import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash
from lodestrata.llm.components import connected


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {i: i for i in fps}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in fps:
        for j in fps:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("part", [simhash.PART, 2])
def test_against_brute_force(spark, make_docs, part, monkeypatch):
    rnd = random.Random(5)
    words = [f"W{i}\u00c9" for i in range(30)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 200))) for _ in range(25)]
    texts = {100 + i: t.replace(rnd.choice(words), "x", 1) if rnd.random() < 0.7 else t for i, t in enumerate(base * 5)} | {1: None, 2: "", 3: "one two", 4: "a\u00a0b\u2003c d"}
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, part))
    found = {r.doc_id: r for r in simhash.near_duplicates(make_docs(list(texts.items()))).collect()}
    fps = {i: brute_print(t) for i, t in texts.items()}
    assert {i: found[i].fp & (1 << 64) - 1 for i in fps} == fps
    assert {i: found[i].component_id for i in fps} == brute_components(fps)


def test_odd_rows_and_empty_table(make_docs, odd_rows):
    found = simhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert simhash.near_duplicates(make_docs([])).count() == 0
    kept = simhash.deduplicate(make_docs(odd_rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, None], key=str)
    assert kept.columns == make_docs(odd_rows).columns


def test_tile_pairs_are_exact():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    found = {tuple(sorted(p)) for i, j in simhash.tile_pairs(fps, tile=16) for p in zip(i.tolist(), j.tolist())}
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(int(fps[i] ^ fps[j])).count("1") <= 3}


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in connected(links).collect()}
    assert all(labels[i] == 0 for i in range(201)) and labels[501] == 500
    assert connected(links.limit(0)).count() == 0


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_deduplicate_finds_all_pairs_of_similar_shingles(make_docs):
    rnd = random.Random(9)
    texts = {}
    for i in range(120):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(60, 300))]
        texts[2 * i] = " ".join(w)
        for at in rnd.sample(range(len(w)), rnd.randint(0, len(w) // 25)):
            w[at] = "edited"
        texts[2 * i + 1] = " ".join(w)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    kept = sorted(r.doc_id for r in simhash.deduplicate(make_docs(list(texts.items()))).collect())
    assert kept == sorted(set(up.values())) and 125 < len(kept) < 220


def test_members_of_a_band_that_the_first_does_not_link_are_compared(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "BANDS", 64)
    monkeypatch.setattr(simhash, "ROWS", 2)
    rnd = random.Random(12)
    w = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(w[:140] + [f"v{i}" for i in range(60)])), (1, " ".join(w)), (2, " ".join(w[:-1] + ["other"]))]
    rows += [(10 + i, " ".join(f"x{rnd.randint(0, 999)}" for _ in range(50))) for i in range(5)]
    assert sorted(r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect()) == [0, 1, 10, 11, 12, 13, 14]


def test_null_and_repeated_ids_drop_no_other_text(make_docs):
    a, b, c, e, f = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcef")
    rows = [(1, a), (None, a), (None, b), (2, c), (2, e), (3, c), (None, f), (None, f)]
    kept = [(r.doc_id, r.text) for r in simhash.deduplicate(make_docs(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (2, c), (2, e), (None, f)], key=str)


def test_a_class_without_an_id_connects_others(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "cast(case text when 'a' then 0 when 'b' then 7 else 63 end as long) as fp"))
    found = simhash.near_duplicates(make_docs([(4, "a"), (None, "b"), (9, "c")])).collect()
    assert {r.component_id for r in found} == {4}


def test_a_large_group_below_the_similarity_is_compared_in_tiles(make_docs, monkeypatch):
    """Copies of one text with many edits each: most pairs are too far apart, and links are those of all pairs."""
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rnd = random.Random(14)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(70):
        w = list(base)
        for at in rnd.sample(range(len(w)), rnd.randint(4, 9)):
            w[at] = f"e{rnd.randint(0, 3)}"
        texts[i] = " ".join(w)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    kept = sorted(r.doc_id for r in simhash.deduplicate(make_docs(list(texts.items()))).collect())
    assert kept == sorted(set(up.values())) and 1 < len(kept) < 60


def test_forest_of_a_tile_against_sets():
    rng = np.random.default_rng(15)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))) for _ in range(80)]
    labels = np.arange(80)
    found = simhash._forest(labels + 100, labels, sets, 0.5) - 100
    a, b = simhash.Forest(80), simhash.Forest(80)
    for i, j in found:
        assert len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j])) and a.join(int(i), int(j))
    for i in range(80):
        for j in range(i):
            if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j])):
                b.join(i, j)
    assert [a.find(i) for i in range(80)] == [b.find(i) for i in range(80)]


def wide_print(hashes):
    """A fingerprint's words, bit by bit."""

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ x >> 31

    sets = [hashes] + [[mixed(h ^ mixed(k)) for h in hashes] for k in (1, 2, 3)]
    return [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s)) for s in sets]


def test_wide_fingerprints_bit_by_bit(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    for n in (0, 1, 4, 5, 100):
        h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        assert simhash.wide_fingerprint(h).tolist() == wide_print(h.tolist())
        assert int(simhash.wide_fingerprint(h)[0]) == simhash.fingerprint(h)


def test_the_stage_links_nothing_that_its_fingerprints_keep_apart(make_docs, monkeypatch):
    """Fingerprints by the row's id in place of those by text: only exact copies go."""
    w = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:-1] + ["other"])), (2, " ".join(w)), (3, " ".join(w[1:]))]
    assert [r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect()] == [0]
    real = simhash.sketches

    def apart(df):
        words = [f"xxhash64(digest, {k}) as f{k}" for k in range(4)]
        return real(df).selectExpr("uid", "doc_id", "digest", "n", *words)

    monkeypatch.setattr(simhash, "sketches", apart)
    assert sorted(r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect()) == [0, 1, 3]


def test_chains_of_a_bucket_against_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "LEFT", 8)
    monkeypatch.setattr(simhash, "RIGHT", 16)
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 63, (20, 4)).astype(np.uint64)
    bits = np.unpackbits(base[rng.integers(0, 20, 150)].view(np.uint8), axis=1)
    bits ^= rng.random(bits.shape) < rng.choice([0.05, 0.15, 0.2], 150)[:, None]
    fps, sizes = np.packbits(bits, axis=1).view(np.uint64), np.sort(rng.integers(1, 40, 150))
    fps[-1] = ~fps[-2]  # 256 bits apart
    bits = np.unpackbits(fps.view(np.uint8), axis=1)
    far = (bits[:, None] ^ bits[None]).sum(axis=2, dtype=int)
    a, b = simhash.Forest(150), simhash.Forest(150)
    for i, j, x in simhash.chains(fps, sizes, 0.8):
        assert i < j and x == far[i, j] <= (78 if sizes[i] < 5 else 70) and sizes[i] >= 0.8 * sizes[j] - 1e-9 and a.join(int(i), int(j))
    for i in range(150):
        for j in range(i + 1, 150):
            if far[i, j] <= (78 if sizes[i] < 5 else 70) and sizes[i] >= 0.8 * sizes[j] - 1e-9:
                b.join(i, j)
    assert [a.find(i) for i in range(150)] == [b.find(i) for i in range(150)]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_short_texts_and_edits_meet_also_in_bands_of_more_bits_and_parts(make_docs, monkeypatch, crowd):
    """Sets of four shingles in sets of five, and texts of 120 words with one edit."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "WIDE_PART", simhash.WIDE_PART if crowd > 1 else 2)
    rnd = random.Random(22)
    rows = []
    for i in range(60):
        w = [f"v{rnd.randint(0, 9999)}" for _ in range(9 if i % 2 else 120)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] if i % 2 else w[:60] + ["edited"] + w[61:]))]
    kept = sorted(r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect())
    assert kept == [2 * i for i in range(60)]
    assert simhash.bands(120).shape[1] == (simhash.ROWS if crowd > 1 else 7)
