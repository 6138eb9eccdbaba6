"""Enrichment of records: deterministic fallback, scoring and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.functions import text as tx
from sievewell.functions.text import bind
from sievewell.operators.guardrail import kind_of, parse_answer, schema_issues, typed_answer


def _filled(df: DataFrame, *cols: str) -> Column:
    """First non-empty of the columns that exist, else the empty string."""
    have = [F.nullif(F.col(c), F.lit("")) for c in cols if c in df.columns]
    return F.coalesce(*have, F.lit(""))


def fallback_enrichment(df: DataFrame, name: str = "name") -> Column:
    """An answer struct made from the record's own fields."""
    indication = _filled(df, "indication", "description")
    mechanism = _filled(df, "mechanism_of_action", "pharmacodynamics")
    groups = F.array_join("groups", ", ") if "groups" in df.columns else F.lit("")
    groups = F.coalesce(groups, F.lit(""))
    bits = F.array_compact(
        F.array(
            F.when(F.length(name) > 0, F.concat(F.col(name), F.lit(" is a drug in the DrugBank dataset."))),
            F.when(groups != "", F.concat(F.lit("It belongs to the following group(s): "), groups, F.lit("."))),
            F.when(indication != "", F.concat(F.lit("Typical indications include: "), F.substring(indication, 1, 200))),
        )
    )
    summary = F.when(F.size(bits) > 0, F.array_join(bits, " ")).otherwise(
        F.lit("Information not specified in the source record.")
    )
    first = F.when(indication != "", F.substring(indication, 1, 120)).otherwise(F.lit("Not specified"))
    how = F.when(mechanism != "", F.substring(mechanism, 1, 240)).otherwise(F.lit("Mechanism not specified."))
    return F.struct(
        summary.alias("summary"),
        F.array(first).alias("primary_indications"),
        how.alias("mechanism_summary"),
        F.lit("Safety information not specified in the source record.").alias("safety_notes"),
        F.array(F.lit("not-specified")).alias("tags"),
    )


def chosen_enrichment(df: DataFrame, content: str | None, name: str = "name") -> Column:
    """The model's answer where it parses and fits the schema, else the fallback from the record."""
    fallback = fallback_enrichment(df, name)
    if content is None:
        return fallback

    def pick(v: Column) -> Column:
        a = typed_answer(v)
        fields = ["summary", "primary_indications", "mechanism_summary", "safety_notes", "tags"]
        given = F.struct(*[a[f].alias(f) for f in fields])
        return F.when(v.isNotNull() & (F.size(schema_issues(v)) == 0), given).otherwise(fallback)

    return bind(parse_answer(F.col(content)), pick)


# Deduction per issue.
_DEDUCTIONS = {
    "summary_empty": (0.25, "Field summary is empty string"),
    "indications_empty": (0.15, "Field primary_indications is empty list"),
    "indications_few": (0.05, "Field primary_indications has fewer than 2 items"),
    "mechanism_empty": (0.20, "Field mechanism_summary is empty string"),
    "safety_empty": (0.20, "Field safety_notes is empty string"),
    "tags_empty": (0.15, "Field tags is empty list"),
    "tags_few": (0.05, "Field tags has fewer than 3 items"),
    "generic": (0.10, "Multiple text fields rely on generic 'not specified' style wording"),
    "name_absent": (0.05, "Drug name from source does not appear in enrichment text"),
}


def dq_score(df: DataFrame, enriched: str, source_name: str | None = None) -> DataFrame:
    """Add dq_score (1 minus deductions, within 0..1), dq_field_issues and dq_hallucination_issues."""
    e = F.col(enriched)
    is_blank = lambda f: F.length(tx.strip(F.coalesce(e[f], F.lit("")))) == 0
    n_ind = F.coalesce(F.size(e["primary_indications"]), F.lit(0))
    n_tags = F.coalesce(F.size(e["tags"]), F.lit(0))
    lowered = [F.lower(F.coalesce(e[f], F.lit(""))) for f in ("summary", "mechanism_summary", "safety_notes")]
    generic = F.lit(0)
    for t in lowered:
        hit = F.lit(False)
        for phrase in P.GENERIC_PHRASES:
            hit = hit | F.contains(t, F.lit(phrase))
        generic = generic + hit.cast("int")
    conditions = {
        "summary_empty": is_blank("summary"),
        "indications_empty": n_ind == 0,
        "indications_few": n_ind == 1,
        "mechanism_empty": is_blank("mechanism_summary"),
        "safety_empty": is_blank("safety_notes"),
        "tags_empty": n_tags == 0,
        "tags_few": n_tags.between(1, 2),
        "generic": generic >= 2,
    }
    name_absent = F.lit(False)
    if source_name is not None:
        n = tx.strip(F.coalesce(F.col(source_name), F.lit("")))
        name_absent = (n != "") & ~F.contains(F.concat_ws(" ", *lowered), F.lower(n))
    score = F.lit(1.0)
    for key, cond in {**conditions, "name_absent": name_absent}.items():
        score = score - F.when(cond, F.lit(_DEDUCTIONS[key][0])).otherwise(F.lit(0.0))
    issue = lambda key, cond: F.when(cond, F.lit(_DEDUCTIONS[key][1]))
    return df.withColumns(
        {
            "dq_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)),
            "dq_field_issues": F.array_compact(F.array(*[issue(k, c) for k, c in conditions.items()])),
            "dq_hallucination_issues": F.array_compact(F.array(issue("name_absent", name_absent))),
        }
    )


def required_issues(value: Column) -> Column:
    """Issues of the required fields of a parsed (variant) answer."""
    found = []
    for f in P.ENRICHED_FIELDS:
        kind = kind_of(value, f"$.{f}")
        text = F.try_variant_get(value, f"$.{f}", "string")
        items = F.try_variant_get(value, f"$.{f}", "array<variant>")
        found.append(
            F.when(kind.isNull(), F.lit(f"Missing field: {f}"))
            .when(kind == "VOID", F.lit(f"Field {f} is None"))
            .when((kind == "STRING") & (F.length(tx.strip(text)) == 0), F.lit(f"Field {f} is empty string"))
            .when(F.startswith(kind, F.lit("ARRAY")) & (F.size(items) == 0), F.lit(f"Field {f} is empty list"))
        )
    return F.array_compact(F.array(*found))


def combined_text(value: Column, fields: list[str] = P.ENRICHED_FIELDS, lists: bool = True) -> Column:
    """Texts and list items of the fields, in order, lower-cased and joined by blanks."""
    parts = []
    for f in fields:
        kind = kind_of(value, f"$.{f}")
        parts.append(F.when(kind == "STRING", F.try_variant_get(value, f"$.{f}", "string")))
        if lists:
            items = F.try_variant_get(value, f"$.{f}", "array<string>")
            parts.append(F.when(F.size(items) > 0, F.array_join(items, " ")))
    return F.lower(F.concat_ws(" ", *parts))


def red_flags(text: Column, patterns: list[str] = P.RED_FLAG_PATTERNS) -> Column:
    """The patterns found in a lower-case text, as issues."""
    return F.array_compact(
        F.array(*[F.when(text.rlike(p), F.lit(f"Hallucination pattern matched: '{p}'")) for p in patterns])
    )


def profile_warnings(value: Column, groups: Column) -> Column:
    """Overconfident phrases of a profile answer, and use claimed for a withdrawn record."""
    text = combined_text(value, ["mechanism_of_action", "warnings", "safe_usage", "summary"], lists=False)
    phrases = [
        F.when(F.contains(text, F.lit(p)), F.lit(f"Potential hallucination: contains phrase '{p}'"))
        for p in P.PROFILE_RED_FLAGS
    ]
    withdrawn = F.coalesce(F.exists(groups, lambda g: F.lower(g) == "withdrawn"), F.lit(False))
    claimed = F.contains(text, F.lit("widely used")) | F.contains(text, F.lit("first-line"))
    phrases.append(F.when(withdrawn & claimed, F.lit("Drug is withdrawn but LLM claims it's widely used.")))
    return F.array_compact(F.array(*phrases))


def validate_enriched(df: DataFrame, value: str, threshold: float = P.VALID_SCORE_THRESHOLD) -> DataFrame:
    """Add field_issues, hallucination_issues, score and valid for a variant column."""
    v = F.col(value)
    d = df.withColumns({"field_issues": required_issues(v), "hallucination_issues": red_flags(combined_text(v))})
    n_f, n_h = F.size("field_issues"), F.size("hallucination_issues")
    raw = (
        F.lit(1.0)
        - F.lit(0.1) * (n_f + n_h)
        - F.when(n_f > 0, F.lit(0.1)).otherwise(F.lit(0.0))
        - F.when(n_h > 0, F.lit(0.1)).otherwise(F.lit(0.0))
    )
    d = d.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return d.withColumn("valid", (F.col("score") >= threshold) & (n_f == 0) & (n_h == 0))


def enriched_records(df: DataFrame, raw_cols: list[str], enriched: str, processed_at: Column) -> DataFrame:
    """Nested output: raw record, answer, scores, time stamp."""
    return df.select(
        F.struct(*raw_cols).alias("raw"),
        F.col(enriched).alias("llm_enriched"),
        "dq_score",
        "dq_field_issues",
        "dq_hallucination_issues",
        processed_at.alias("processed_at"),
    )
