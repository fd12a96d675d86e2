"""Building models in STEP text (IFC): reading as tables, and linking with the stored floors, rooms and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources import step

#: Entities that are not elements.
STOREY, SPACE, PROJECT = "IFCBUILDINGSTOREY", "IFCSPACE", "IFCPROJECT"
PLACES = (PROJECT, "IFCSITE", "IFCBUILDING", STOREY, SPACE)
#: Relations, types and styles of products; other rooted entities with the seven attributes of a product are elements.
NO_PRODUCT = r"^IFCREL|(?:TYPE|STYLE)$"
LINE = r"(?is)^\s*#(\d+)\s*=\s*(IFC[A-Za-z0-9]+)\s*\((.*)\)\s*;?\s*$"
TEXT = r"'((?:[^']|'')*)'"
#: One argument: lists nest up to three deep, strings may hold anything.
_STRING = "'[^']*+'"
_LIST = f"[(](?:[^()']++|{_STRING}|[(](?:[^()']++|{_STRING}|[(](?:[^()']++|{_STRING})*+[)])*+[)])*+[)]"
ARGUMENT = f"((?:[^,()']++|{_STRING}|{_LIST})++)"


def step_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """(ref, type, args) of the data records of a STEP file; a column ``file`` is kept."""
    found = lines.select(*(c for c in lines.columns if c == "file"), *(F.regexp_extract(text, LINE, i).alias(n) for i, n in ((1, "ref"), (2, "type"), (3, "args"))))
    return found.where(F.col("ref") != "").withColumns({"ref": F.col("ref").cast("long"), "type": F.upper("type")})


def arguments(args: Column) -> Column:
    """The arguments of a record as an array of their texts."""
    return F.transform(F.regexp_extract_all(args, F.lit(ARGUMENT), F.lit(1)), lambda a: F.trim(a, F.lit(" \t\r\n")))


def plain(text: Column) -> Column:
    """What a quoted string means, null for what is no string: doubled quotes are one, escapes are decoded."""
    inner = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'"))
    return F.when(text.startswith("'"), step.decoded(inner))


def _key(rows: DataFrame, *names: str) -> list[str]:
    """The file, where rows come from several, and other columns."""
    return [*(c for c in rows.columns if c == "file"), *names]


def entities(rows: DataFrame) -> DataFrame:
    """(file, ref, type, guid, name, n_args) of rooted entities: global id first, name after the owner's reference."""
    found = rows.where(F.col("args").rlike(r"^\s*'")).withColumn("a", arguments(F.col("args")))
    return found.select(*_key(rows, "ref", "type"), plain(F.get("a", F.lit(0))).alias("guid"), plain(F.get("a", F.lit(2))).alias("name"), F.size("a").alias("n_args"))


def is_element() -> Column:
    """Whether a row of :func:`entities` is a product that is no place."""
    return ~F.col("type").isin(*PLACES) & ~F.col("type").rlike(NO_PRODUCT) & (F.col("n_args") >= 7)


def contained(rows: DataFrame) -> DataFrame:
    """(file, ref, container): what spatial containment and aggregation say of each object."""
    a = arguments(F.col("args"))
    wanted = rows.where(F.col("type").isin("IFCRELCONTAINEDINSPATIALSTRUCTURE", "IFCRELAGGREGATES")).withColumn("a", a)
    within = F.col("type") == "IFCRELCONTAINEDINSPATIALSTRUCTURE"
    objects, holder = F.when(within, F.get("a", F.lit(4))).otherwise(F.get("a", F.lit(5))), F.when(within, F.get("a", F.lit(5))).otherwise(F.get("a", F.lit(4)))
    both = wanted.select(*_key(rows), F.explode(F.regexp_extract_all(objects, F.lit(r"#(\d+)"), F.lit(1))).alias("ref"), F.regexp_extract(holder, r"#(\d+)", 1).alias("container"))
    both = both.where("container <> ''").withColumns({"ref": F.col("ref").cast("long"), "container": F.col("container").cast("long")})
    return both.groupBy(*_key(rows, "ref")).agg(F.min("container").alias("container"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(file, ref, type, guid, name, container) of the projects, storeys, spaces and elements of IFC files.

    ``#`` numbers hold within a file only, so every join has the file's path in its key.
    """
    rows = cut(step_rows(step.records(spark, path), "text"))
    found = entities(rows).where(F.col("type").isin(STOREY, SPACE, PROJECT) | is_element()).drop("n_args")
    return found.join(contained(rows), ["file", "ref"], "left")


def find_or_create(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with the stored row's id (the smallest), null where one has to be created."""
    first = stored.groupBy(*keys).agg(F.min("id").alias("id"))
    return wanted.join(first, keys, "left")


def link(elements: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements whose global id is stored, with the stored element (of equal ids the last), and those to create."""
    last = stored.where(F.col("guid").isNotNull() & (F.col("guid") != "")).groupBy("guid").agg(F.max("id").alias("stored_id"))
    return elements.join(last, "guid"), elements.join(last, "guid", "left_anti")


def rooms_of(model: DataFrame) -> DataFrame:
    """(file, ref, room): the space an element goes to: its own, the first of its storey, or none (the fallback room)."""
    spaces = model.where(F.col("type") == SPACE).select(*_key(model), F.col("ref").alias("space"), F.col("container").alias("storey"))
    first = spaces.groupBy(*_key(model, "storey")).agg(F.min("space").alias("first")).withColumnRenamed("storey", "container")
    elements = model.where(~F.col("type").isin(*PLACES)).select(*_key(model, "ref", "container"))
    own = spaces.select(*_key(model), F.col("space").alias("container"), "space")
    found = elements.join(own, _key(model, "container"), "left").join(first, _key(model, "container"), "left")
    return found.select(*_key(model, "ref"), F.coalesce("space", "first").alias("room"))
