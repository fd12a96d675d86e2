"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


def test_queries_take_all_rows_of_their_tables(spark, duck):
    def count(sql):
        return duck.execute(sql).fetchone()[0]

    taken = {name: catalog.queries()[name](spark, SF) for name in ("polyline_explode", "ellipse_tessellate", "rule_cross", "xml_entities")}
    assert taken["polyline_explode"].count() == count("SELECT count(*) FROM lineitem")
    assert taken["ellipse_tessellate"].count() == 49 * count("SELECT count(*) FROM customer")
    assert taken["rule_cross"].count() == 2 * count("SELECT count(*) FROM orders")
    assert taken["xml_entities"].selectExpr("sum(length(decoded))").first()[0] == count("SELECT sum(length(html)) FROM pages")


def test_robust_range_of_few_points_takes_each(spark, duck):
    found = {r.axis: r.extent for r in catalog.queries()["robust_axis_range"](spark, SF).collect()}
    assert duck.execute("SELECT count(*) FROM lineitem").fetchone()[0] < 50_000
    for axis, column in (("x", "l_extendedprice / 1000"), ("y", "l_quantity"), ("z", "l_discount * 100")):
        v = sorted(float(r[0]) for r in duck.execute(f"SELECT {column} FROM lineitem").fetchall())
        assert found[axis] == pytest.approx(v[int((len(v) - 1) * 0.995)] - v[int((len(v) - 1) * 0.005)])


def test_deviation_stats_hold_the_percentiles(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding[1:3] FROM embeddings").fetchall()
    own, ref = ([r[1] for r in rows if r[0] % 2 == k] for k in (1, 0))
    near = [min(math.dist(a, b) for b in ref) for a in own]
    near = sorted(d for d in near if d <= 0.1)
    found = catalog.queries()["deviation_stats"](spark, SF).first()
    assert found.matched == len(near) > 20
    assert (found.lo, found.hi) == pytest.approx((near[0], near[-1]), abs=1e-8)
    for share, got in ((0.5, found.p50), (0.95, found.p95)):
        assert got == pytest.approx(near[int((len(near) - 1) * share)], abs=1e-8)


def test_each_oracle_is_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
