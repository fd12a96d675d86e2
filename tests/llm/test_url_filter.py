import random

import numpy as np

from lodestrata.llm import url_filter as u


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def judged(spark, urls, rules=u.RULES):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' as host", "'z' as rule", "'z' as id", "'z' as keys")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(df, rules).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}{rnd.choice(['://', '://', ':', ''])}{rnd.choice(['', 'a.', 'A.b.'])}{rnd.choice(['example.com', 'Example.NET', 'org', 'xorg', 'net', '.com', 'a..com'])}{rnd.choice(['', '/', '/en/', '/en/7', '/en/71?x=/de/', '/de/8#a', '?q', '#f', '/es/1'])}" for _ in range(600)]
    urls += [None, "", "x://", "://com/en/", "http://com/en/" + "y" * 30_000, "http://" + "a." * 5_000 + "com/en/"]
    found = judged(spark, urls)
    assert found == {i: brute(x, u.RULES) for i, x in enumerate(urls)}


def test_many_rules(spark):
    rules = [("block" if i % 2 else "allow", f"h{i}.com", f"/{i % 7}") for i in range(500)]
    urls = [f"http://w.h{i}.com/{i % 5}/x" for i in range(700)]
    assert judged(spark, urls, rules) == {i: brute(x, rules) for i, x in enumerate(urls)}


def test_empty_table_and_no_rules(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://com/en/"], []) == {0: ("com", "/en/", None, "allow")}


def test_cascade_is_exact_over_its_universe():
    listed, others = u.hashes([f"in{i}" for i in range(500)]), u.hashes([f"out{i}" for i in range(20_000)])
    first = u.Level.of(listed, 0.2, 3)
    cascade = u.Cascade.above(first, listed, others[first.has(others)])
    assert cascade.has(listed).all() and not cascade.has(others).any() and len(cascade.levels) > 2


def test_level_has_no_false_negatives():
    keys = u.hashes([str(i) for i in range(1000)])
    assert u.Level.of(keys, 0.01, 1).has(keys).all()
    assert np.unique(u.Level.of(keys, 0.01, 1).positions(keys)).size > 1000
