import math

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import pivot_search as p


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, (q, a) in enumerate(ok):
        if q % 50 == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, b)), c) for ci, (c, b) in enumerate(ok) if ci != qi)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'z' as id", "'z' as x", "'z' as uid", "'z' as query")
    return sorted(map(tuple, p.top_k(df, F.col("vec_id") % 50 == 0).collect()))


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(i, (centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(0, 0.1, 12)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(8)] + [(None, rows[0][1]), (2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [0.5] * 3), (2250, []), (50, rows[50][1])]
    monkeypatch.setattr(p, "ANNULUS", 16)
    monkeypatch.setattr(p, "PIVOTS", 5)
    monkeypatch.setattr(p, "QUERIES", 7)
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    assert found(spark, rows) == [(0, 1, 1, 384 * 256 // 1)] or found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []


def test_large_values_stay_exact(spark):
    rows = [(0, [3.0e6 + 0.1, -7.0e6]), (1, [2.9e6, 1.0e6]), (2, [1.0e6, -9.0e6])]
    assert found(spark, rows) == brute(rows)
