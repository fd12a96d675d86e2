"""All queries by name, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import model_catalog, spatial_catalog
from .fixtures import DUCK, view
from .sql_catalog import SQL

Query = Callable[[SparkSession, str], DataFrame]


def run_sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark SQL over the views that the text names in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in names})


def duck_sql(text: str) -> str:
    """The text for DuckDB, its views as common table expressions."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    body = re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
    views = ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"


def queries() -> dict[str, Query]:
    plain = {name: partial(run_sql, q[0] if isinstance(q, tuple) else q) for name, q in SQL.items()}
    return plain | spatial_catalog.QUERIES | model_catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    plain = {name: duck_sql(q[1] if isinstance(q, tuple) else q) for name, q in SQL.items()}
    return plain | {name: duck_sql(q) for name, q in (spatial_catalog.ORACLES | model_catalog.ORACLES).items()}
