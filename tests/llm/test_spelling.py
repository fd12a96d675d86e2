import random
import re
import zlib
from collections import Counter

import pytest

from lodestrata.llm import spelling as s

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words):
    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_apart(w, o)] for w in words}
    best = {w: min(o, key=lambda x: (-words[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def ours(spark, words, parts=3):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(parts)
    return sorted(map(tuple, s.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("letters", ["ab", "abcéÿ", "a"])
def test_small_alphabets_against_all_pairs(spark, letters):
    draw = random.Random(letters)
    words = {"".join(draw.choices(letters, k=draw.randint(1, 9))): draw.choice([2, 3, 30, 31, 400, 5000]) for _ in range(350)}
    assert ours(spark, words) == brute_variants(words)


def test_each_link_once_and_both_ways(spark):
    words = {w: 2 for w in ["aaa", "aa", "a", "aab", "ab", "b", "abb", "aba", "baa", "\U0001f600a", "\U0001f600", "\U0001f601a", "a\U0001f600a"]}
    pairs = [(r["word"], r["other"]) for r in s.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a != b and one_apart(a, b))


def test_chains_end_at_the_last_form(spark):
    chain = {"abcdefg" + "x" * i: 2 * 11 ** (9 - i) for i in range(9)} | {"zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50}
    found = ours(spark, chain)
    assert found == brute_variants(chain)
    assert {r[2] for r in found if r[0].startswith("abc")} == {"abcdefg"} and [r[1] for r in found if r[0] == "zzzzzzz"] == ["zzzzzzx"]
    with pytest.raises(ValueError):
        s.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_long_words_and_hot_prefixes(spark):
    draw = random.Random(3)
    words = {"prefix" + "".join(draw.choices("abcd", k=6)): draw.randint(2, 300) for _ in range(1500)}  # all below one child
    long = "".join(draw.choices("abcde", k=4000))
    words |= {long: 2, long[:3999]: 40, long[:100] + "z" + long[101:]: 3, long[:2000] + long[2001:]: 4}
    got = ours(spark, words, parts=8)
    assert got == brute_variants(words)
    assert [r[1] for r in got if r[0] == long] == [long[:3999]]


def test_counts_of_whole_texts_and_odd_rows(spark, make_docs, odd_rows):
    text = "Straßenbahn ÜBERSEE-Kabel caféhaus×mal it's short Sibilant sibilant x1y2sibilants İstanbulİlar 日本sibilant"
    rows = odd_rows + [(i, text) for i in range(40)] + [(None, text), (None, text), (7, "Sibilant " * 5000)]
    df = make_docs(rows)
    assert {r["word"]: r["n"] for r in s.counts(df).collect()} == brute_counts(rows)
    words = brute_counts(rows)
    got = sorted(map(tuple, s.variants(s.counts(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute_variants(words)
    assert s.counts(make_docs([])).count() == 0 and ours(spark, {}) == [] and ours(spark, {"single": 4}) == [("single", None, "single", 4, 0, None)]


def test_light_children_are_few(spark):
    """A word moves at most log2(words) + 1 times."""
    draw = random.Random(9)
    words = sorted({"".join(draw.choices("abcdef", k=draw.randint(3, 9))) for _ in range(3000)})
    df = spark.createDataFrame([(i, w, 2, len(w)) for i, w in enumerate(words)], "wid long, word string, n long, depth int")
    per = Counter(r["wid"] for r in s.light_moves(df).collect())
    assert max(per.values()) <= len(words).bit_length() + 1


def test_against_sql(spark):
    import duckdb

    where = "/root/testdata/sf0.01"
    found = sorted(map(tuple, s.query(spark, where).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
        assert found == sorted(db.sql(s.ORACLE).fetchall())
