"""Evidence records from nested XML rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.operators.standardize import clean_text, drop_empty_text, join_texts, list_texts, primary_id

# The fields of a nested record that are read, by their names in the files.
RECORD_SCHEMA = """
`drugbank-id` ARRAY<STRUCT<_VALUE: STRING, _primary: BOOLEAN>>, name STRING, `average-mass` STRING, state STRING,
description STRING, indication STRING, pharmacodynamics STRING, `mechanism-of-action` STRING, toxicity STRING, metabolism STRING,
absorption STRING, `half-life` STRING, `protein-binding` STRING, `route-of-elimination` STRING, `volume-of-distribution` STRING, clearance STRING,
groups STRUCT<`group`: ARRAY<STRING>>, synonyms STRUCT<synonym: ARRAY<STRING>>,
categories STRUCT<category: ARRAY<STRUCT<category: STRING>>>, `food-interactions` STRUCT<`food-interaction`: ARRAY<STRING>>,
`drug-interactions` STRUCT<`drug-interaction`: ARRAY<STRUCT<description: STRING>>>
"""

_DIRECT = [f for f in P.EVIDENCE_FIELDS if f not in ("drug_interactions", "food_interactions")]


def _path(df: DataFrame, *steps: str) -> Column | None:
    """A nested field, or null when the inferred schema lacks it."""
    schema, col = df.schema, None
    for step in steps:
        while schema.typeName() == "array":
            schema = schema.elementType
        if schema.typeName() != "struct" or step not in schema.fieldNames():
            return None
        col = F.col(f"`{step}`") if col is None else col.getField(step)
        schema = schema[step].dataType
    return col


def _items(df: DataFrame, *steps: str) -> Column:
    """A nested field as an array, whether it was inferred as one element or several."""
    col = _path(df, *steps)
    if col is None:
        return F.array().cast("array<string>")
    kind = df.select(col.alias("x")).schema["x"].dataType.typeName()
    return col if kind == "array" else F.when(col.isNotNull(), F.array(col))


def category_names(df: DataFrame) -> Column:
    """Category names, which are nested one level deeper in some files."""
    nested = _path(df, "categories", "category", "category")
    names = _items(df, "categories", "category", "category") if nested is not None else _items(df, "categories", "category")
    return list_texts(names)


def evidence_records(df: DataFrame, ingest_dt: Column) -> DataFrame:
    """One record per row with an id, a name and some text; list fields as arrays."""
    raw = lambda name: F.coalesce(clean_text(_path(df, name)), F.lit("")) if _path(df, name) is not None else F.lit("")
    interactions = _items(df, "drug-interactions", "drug-interaction", "description")
    records = df.select(
        F.btrim(primary_id(_items(df, "drugbank-id"))).alias("drug_id"),
        clean_text(F.col("name")).alias("drug_name"),
        *[raw(f.replace("_", "-")).alias(f) for f in _DIRECT],
        F.coalesce(join_texts(interactions), F.lit("")).alias("drug_interactions"),
        F.coalesce(join_texts(_items(df, "food-interactions", "food-interaction")), F.lit("")).alias("food_interactions"),
        list_texts(_items(df, "synonyms", "synonym")).alias("synonyms"),
        list_texts(_items(df, "groups", "group")).alias("groups"),
        category_names(df).alias("categories"),
        ingest_dt.alias("ingest_dt"),
    )
    return drop_empty_text(records, P.EVIDENCE_FIELDS, ["drug_id", "drug_name"])


def sample_records(df: DataFrame, limit: int = 200) -> DataFrame:
    """Primary id, all ids, name, description, indication and groups of the first records by id."""
    ids = _items(df, "drugbank-id")
    return (
        df.select(
            primary_id(ids).alias("primary_id"),
            F.filter(F.transform(ids, lambda x: x["_VALUE"]), lambda x: x.isNotNull()).alias("all_ids"),
            "name",
            "description",
            "indication",
            list_texts(_items(df, "groups", "group")).alias("groups"),
        )
        .orderBy("primary_id")
        .limit(limit)
    )
