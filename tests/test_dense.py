"""Neighbours in heaps and order statistics of shared values: right results from rows that grow no faster than the input."""

import random

from lodestrata.operators import cleaning, indexing, spatial

SCHEMA = "id long, x double, y double, z double"


def heap(n=600, copies=40):
    """A heap far narrower than the radius, copies of one place, and a few points far away."""
    draw = random.Random(3)
    rows = [(i, *(draw.gauss(0, 0.01) for _ in range(3))) for i in range(n)]
    rows += [(n + i, 0.5, 0.5, 0.5) for i in range(copies)]
    return rows + [(n + copies + i, 0.7 + 0.03 * i, 0.0, -0.4) for i in range(6)]


def d2(p, q):
    return (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3])


def counting(monkeypatch, made):
    plain = spatial.near_pairs

    def near_pairs(*args, **more):
        out = plain(*args, **more)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "near_pairs", near_pairs)
    monkeypatch.setattr(cleaning, "near_pairs", near_pairs)


def test_neighbours_in_a_heap(spark, monkeypatch):
    rows, made = heap(), []
    counting(monkeypatch, made)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in spatial.k_nearest(df, 3, 0.1).collect():
        found.setdefault(r["id"], {})[r["rank"]] = r["other"], r["d2"]
    for p in rows:
        want = sorted((d2(p, q), q[0]) for q in rows if q[0] != p[0])[:3]
        assert found[p[0]] == {k + 1: (o, d) for k, (d, o) in enumerate(want)}
    odd, even = df.where("id % 2 = 1"), df.where("id % 2 = 0")
    got = {r["id"]: r["other"] for r in cleaning.deviation(odd, even, 0.1).collect()}
    for p in rows:
        if p[0] % 2:
            d, o = min((d2(p, q), q[0]) for q in rows if q[0] % 2 == 0)
            assert got[p[0]] == (o if d <= 0.1 * 0.1 else None)
    assert sum(made) <= 30 * len(rows)


def test_clusters_of_a_heap(spark, monkeypatch):
    rows, made = heap(), []
    counting(monkeypatch, made)
    near = {p[0]: {q[0] for q in rows if d2(p, q) <= 0.07 * 0.07} for p in rows}
    core = {i for i, n in near.items() if len(n) >= 4}
    name = {}
    for i in sorted(core):
        todo = [i] if i not in name else []
        while todo:
            j = todo.pop()
            if j not in name:
                name[j] = i
                todo += near[j] & core
    at = {p[0]: p for p in rows}
    want = {i: name.get(min(((d2(at[i], at[j]), j) for j in near[i] & core), default=(0, None))[1]) for i in near}
    assert {r["id"]: r["cluster"] for r in cleaning.dbscan(spark.createDataFrame(rows, SCHEMA), 0.07, 4).collect()} == want
    assert sum(made) <= 30 * len(rows)


def test_a_value_that_many_rows_share_is_one_row(spark, monkeypatch):
    kept, plain = [], indexing.cut
    monkeypatch.setattr(indexing, "cut", lambda df: kept.append(plain(df)) or kept[-1])
    values = [float(i % 5) for i in range(4000)] + [7.5, 9.0, None]
    row = indexing.order_statistics(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"lo": 0.0, "mid": 0.5, "most": 0.9995, "hi": 1.0}).first()
    held = sorted(v for v in values if v is not None)
    assert tuple(row) == tuple(held[int((len(held) - 1) * s)] for s in (0.0, 0.5, 0.9995, 1.0))
    assert kept[0].count() == 7
