"""Standardising: keys, names, casts, deduplication, aliases, message cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.functions.text import blank_to_null, strip


def primary_id(ids: Column) -> Column:
    """Value of the first id marked primary, else of the first id."""
    chosen = F.get(F.filter(ids, lambda x: x["_primary"]), F.lit(0))
    return F.when(chosen.isNotNull(), chosen["_VALUE"]).otherwise(F.get(ids, F.lit(0))["_VALUE"])


def flatten_ids(df: DataFrame, ids: str, keep: list[str], id_col: str = "drug_id") -> DataFrame:
    """One row per id; ids are then made distinct and null ids dropped."""
    exploded = df.select(F.explode_outer(ids).alias("_id"), *keep).select(
        F.col("_id._VALUE").alias(id_col), F.coalesce(F.col("_id._primary"), F.lit(False)).alias("is_primary"), *keep
    )
    return dedupe(exploded.where(F.col(id_col).isNotNull()), id_col, [~F.col("is_primary"), *keep])


def standardize(df: DataFrame, ingest_dt: Column) -> DataFrame:
    """The eight standard columns from a nested record; bad numbers become null."""
    return df.select(
        primary_id(F.col("`drugbank-id`")).alias("drug_id"),
        F.trim("name").alias("drug_name"),
        F.col("`average-mass`").try_cast("double").alias("avg_mass"),
        "description",
        "indication",
        F.col("`mechanism-of-action`").alias("mechanism"),
        "toxicity",
        ingest_dt.alias("ingest_dt"),
    )


def dedupe(df: DataFrame, key: str, order_by: list) -> DataFrame:
    """One row per key: the smallest under the ``order_by`` columns, nulls first.

    An aggregation instead of a window, so a key with very many copies is
    reduced before the shuffle. Null keys count as one key.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order_by)])
    kept = df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return kept.select(*[c if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def dedupe_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows before, rows after and rows removed when only one row per key is kept."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"),
    )


def coalesce_aliases(df: DataFrame, rules: dict[str, list[str]] = P.FIELD_ALIASES) -> DataFrame:
    """Fill each canonical column that is null or blank from its first non-blank alias."""
    have = set(df.columns)
    out = {}
    for canonical, aliases in rules.items():
        sources = [c for c in [canonical, *aliases] if c in have]
        if not sources:
            continue
        filled = [blank_to_null(c) for c in sources]
        # When nothing is filled the canonical value stays as it was.
        last = [F.col(canonical)] if canonical in have else []
        out[canonical] = F.coalesce(*filled, *last)
    return df.withColumns(out)


def first_known(df: DataFrame, cols: list[str], default: str) -> Column:
    """First non-empty of the columns that exist, else the default."""
    have = [F.nullif(F.col(c), F.lit("")) for c in cols if c in df.columns]
    return F.coalesce(*have, F.lit(default))


def drop_empty_text(df: DataFrame, cols: list[str], required: list[str]) -> DataFrame:
    """Keep records with some text and with every required column filled."""
    text = reduce(
        lambda a, b: a | b, [F.length(strip(F.coalesce(F.col(c), F.lit("")))) > 0 for c in cols]
    )
    for c in required:
        text = text & blank_to_null(c).isNotNull()
    return df.where(F.coalesce(text, F.lit(False)))


def clean_text(c: Column) -> Column:
    """Drop carriage returns and surrounding whitespace; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", ""))


def join_texts(items: Column) -> Column:
    """Non-blank texts of a list, one per line."""
    return F.array_join(list_texts(items), "\n")


def list_texts(items: Column) -> Column:
    """Non-blank cleaned texts of a list; a null list gives an empty one."""
    kept = F.filter(F.transform(items, clean_text), lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def search_filter(
    df: DataFrame,
    query: str,
    text_cols: list[str],
    number: str | None = None,
    low: float | None = None,
    high: float | None = None,
    require: str | None = None,
) -> DataFrame:
    """Literal case-insensitive substring over several columns, range, non-empty text."""
    out = df
    if query.strip():
        needle = F.lit(query.lower())
        out = out.where(
            reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in text_cols])
        )
    if number is not None and low is not None:
        out = out.where(F.col(number) >= low)
    if number is not None and high is not None:
        out = out.where(F.col(number) <= high)
    if require is not None:
        out = out.where(F.length(require) > 0)
    return out


def clean_messages(df: DataFrame, value: str, processed_at: Column, keep: list[str] | None = None) -> DataFrame:
    """Parse JSON messages, drop those without text, add length and time stamp.

    Works on batch frames and streams. ``source`` defaults to ``unknown`` only
    where the key is absent; an explicit null stays null. A text that is null or
    no string is dropped too: the record cannot be measured.
    """
    v = F.try_parse_json(F.col(value))
    get = lambda path, t: F.try_variant_get(F.col("_v"), path, t)
    kind = F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.text", "variant"))
    parsed = df.select(*(keep or []), v.alias("_v")).where(kind == "STRING")
    source_there = F.try_variant_get(F.col("_v"), "$.source", "variant").isNotNull()
    return parsed.select(
        *(keep or []),
        get("$.id", "string").alias("id"),
        F.when(source_there, get("$.source", "string")).otherwise(F.lit("unknown")).alias("source"),
        get("$.text", "string").alias("text"),
        F.length(get("$.text", "string")).alias("text_length"),
        processed_at.alias("processed_at"),
    )


def fill_and_limit(df: DataFrame, order_by: list[str], limit: int | None = None) -> DataFrame:
    """Empty strings for null strings; optionally the first ``limit`` records in key order."""
    out = df.na.fill("")
    return out.orderBy(*order_by).limit(limit) if limit else out


def null_if_unreadable(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Tolerant casts: a bad number or date becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})
