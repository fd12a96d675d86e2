"""The views that queries read: points, relational model, documents, journal; in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexing import with_index
from ..session import table

ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
POINT = "l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z, l_suppkey % 4 AS scan_id, l_linenumber AS classification, l_tax AS intensity_raw"
#: View name -> (driver table, select list); the same text for both engines.
PLAIN = {
    "floors": ("nation", "n_nationkey AS floor_id, n_name AS name, n_regionkey AS project_id"),
    "rooms": ("customer", "c_custkey AS room_id, c_nationkey AS floor_id, c_name AS name, c_mktsegment AS kind, c_acctbal AS area"),
    "elements": ("orders", "o_orderkey AS element_id, o_custkey AS room_id, o_orderstatus AS status, o_orderpriority AS kind, concat('G', cast(o_orderkey AS varchar(20))) AS ifc_guid, o_orderdate AS created, o_totalprice AS cost"),
    "findings": ("lineitem", "l_orderkey AS element_id, l_linenumber AS kind, CASE l_returnflag WHEN 'A' THEN 'err' WHEN 'N' THEN 'warn' ELSE 'ok' END AS severity, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'closed' END AS review, l_shipdate AS created_at, l_partkey AS part_id, l_extendedprice AS weight"),
    "docs": ("documents", "doc_id, doc_id % 150 AS room_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS element_id, source AS name, concat('v', cast(1 + doc_id % 5 AS varchar(9))) AS version, doc_id % 2 = 0 AS is_upload, text, n_chars"),
    "operations": ("events", "event_id, ts, user_id AS project, event_type AS operation, value, props AS parameters"),
    "html_docs": ("pages", "page_id, url, html"),
    "comments": ("conversations", "conv_id, turn, role, text"),
    "raw_points": ("lineitem", POINT + ", " + ", ".join(ORDER)),
}
DUCK = {name: f"SELECT {what} FROM {source}" for name, (source, what) in PLAIN.items()} | {
    "points": f"SELECT row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS point_idx, {POINT} FROM lineitem",
    "vec_points": "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings",
}
_kept: dict[tuple[str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; the numbered points are materialised once a session and folder."""
    if name == "points":
        key = spark.sparkContext.applicationId, sf_dir
        if key not in _kept:
            rows = table(spark, sf_dir, "lineitem").selectExpr(*(x.strip() for x in POINT.split(",")), *ORDER)
            kept = ("x", "y", "z", "scan_id", "classification", "intensity_raw")
            _kept[key] = with_index(rows, ORDER, keep=kept).select("point_idx", *kept)  # materialised there
        return _kept[key]
    if name == "vec_points":
        e = table(spark, sf_dir, "embeddings")
        return e.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")))
    source, what = PLAIN[name]
    return spark.sql(f"SELECT {what} FROM {{t}}", t=table(spark, sf_dir, source))
