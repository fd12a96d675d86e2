import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import hard_negatives as h


def brute(rows):
    """rows of (vec_id, embedding, label); every product in Python integers."""
    ok = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for ai, (a, av, al) in enumerate(ok):
        if a % 100:
            continue
        scored = sorted((-sum(s * t for s, t in zip(av, v)), i, label) for j, (i, v, label) in enumerate(ok) if j != ai)
        for minus, pid, _ in [s for s in scored if s[2] == al][:5]:
            fit = [s for s in scored if s[2] != al and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:10]
            out += [(a, pid, r + 1, nid, -minus, -score) for r, (score, nid, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.selectExpr("*", "'z' as id", "'z' as x", "'z' as uid", "'z' as anchor", "'z' as v", "'z' as most", "'z' as place", "'z' as score")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = h.mine(df, F.col("vec_id") % 100 == 0, label)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clouds(n, seed, width=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, width))
    label = np.where(rng.random(n) < 0.4, 3, rng.integers(0, 10, n))  # one label holds over a third
    return [(i, (centres[i % 4] * rng.uniform(0.2, 2) + rng.normal(0, 0.3, width)).tolist(), int(label[i])) for i in range(n)]


def test_against_brute_force_in_blocks_and_tiles(spark, monkeypatch):
    rows = clouds(900, 5)
    rows += [(2000 + i, rows[300][1], i % 3) for i in range(30)]  # ties
    rows += [(None, rows[0][1], 1), (3000, None, 1), (3100, [1.0, None], 1), (3200, [float("nan")] * 10, 1), (3300, [float("inf")] * 10, 2)]
    rows += [(3400, rows[0][1], None), (3500, [0.5] * 3, 1), (3600, [], 1), (300, rows[300][1], rows[300][2]), (-100, rows[100][1], 3), (-7, rows[7][1], -3)]
    expected = brute(rows)
    assert len(expected) > 400
    assert found(spark, rows) == expected
    monkeypatch.setattr(h, "ANCHORS", 4)
    monkeypatch.setattr(h, "TILE", 3)
    assert found(spark, rows) == expected


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) == brute([(100, [], 1), (1, [], 1), (2, [], 2)])
    rows = [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.3], 2), (4, [0.2], 2), (5, [-1.0], 1), (6, [-0.5], 2)]
    assert found(spark, rows) == brute(rows)


def test_large_scores_stay_exact_and_larger_ones_are_an_error(spark):
    rows = [(100, [3.0e6 + 0.1, -7.0e6], 1), (1, [2.9e6, -1.0e6], 1), (2, [1.0e6, -1.0e6], 2), (3, [1.0e6, -1.0000001e6], 4)]
    assert found(spark, rows) == brute(rows) != []
    with pytest.raises(ValueError, match="long"):
        found(spark, [(100, [1.0e8], 1), (1, [1.0e8], 1), (2, [1.0e8], 2)])


def test_bounds_of_a_window():
    score = np.array([0, 1, 9, 10, 11, 999, 2**62, -1, -10])
    low, high = h.bounds(score)
    for s, a, b in zip(score.tolist(), low.tolist(), high.tolist()):
        assert a == -(-30 * s // 100) and b == 90 * s // 100


def test_against_sql(spark):
    import duckdb

    where = "/root/testdata/sf0.01"
    ours = sorted(map(tuple, h.query(spark, where).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
        assert ours == sorted(db.sql(h.ORACLE).fetchall()) != []
