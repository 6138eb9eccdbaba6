"""Quality rules: every rule is a boolean column, all are evaluated in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions.text import preview
from sievewell.operators.ranking import count_and_quantiles
from sievewell.session import broadcast_if_small, written_once

REQUIRED = ["drug_id", "drug_name", "avg_mass", "indication", "mechanism", "description", "toxicity", "ingest_dt"]


def require_columns(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """The frame itself, or an error that lists the missing columns; runs no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.length(F.trim(F.col(c).cast("string"))) == 0)


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, exact: bool = True, min_rows: int = 10):
    """(lower, upper) outlier fences, or None with fewer than ``min_rows`` known values."""
    if exact:
        known, (q1, q3) = count_and_quantiles(df, col, [0.25, 0.75])
    else:
        known = df.where(F.col(col).isNotNull()).count()
        q1, q3 = df.approxQuantile(col, [0.25, 0.75], 0.01) if known else (None, None)
    if known < min_rows:
        return None
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def default_rules(df: DataFrame, bounds: tuple | None) -> dict[str, Column]:
    """The standard rules of a silver table; a rule that is null does not fail the row."""
    mass = F.col("avg_mass")
    rules = {
        "name_missing": blank("drug_name"),
        "id_missing": F.col("drug_id").isNull(),
        "id_duplicate": F.col("_copies").isNotNull(),
        "id_pattern": ~F.col("drug_id").rlike(r"^DB\d+$"),
        "mass_invalid": mass.isNull() | (mass <= 0) | (mass >= 1_000_000),
        "text_short": (F.length(F.trim("indication")) < 10) | (F.length(F.trim("mechanism")) < 10),
        "ingest_missing": blank("ingest_dt"),
    }
    if bounds is not None:
        rules["mass_outlier"] = (mass < bounds[0]) | (mass > bounds[1])
    return rules


def evaluate_rules(df: DataFrame, rules: dict[str, Column] | None = None, key: str = "drug_id") -> DataFrame:
    """Add ``failed_rules``, the names of the rules each row fails.

    Copies of a key are found by an aggregation that is reduced before its
    shuffle; only keys with copies come back to the join, so a hot key is one
    row there and not one window group. They are stored and, if few, sent to the rows,
    which then stay where they are.
    """
    copies = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_copies")).where("_copies > 1")
    if rules is None:
        rules = default_rules(df, iqr_bounds(df, "avg_mass"))
    joined = df.join(broadcast_if_small(written_once(copies, "copied-keys")), key, "left")
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    failed = F.array_compact(F.array(*names))
    return joined.withColumn("failed_rules", failed).drop("_copies").select(*df.columns, "failed_rules")


def is_bad(key: str = "drug_id", strict_null_keys: bool = False) -> Column:
    """A row is bad when it fails a rule; a row without key is bad only when asked for.

    Rejected keys are matched by equality, and a null key equals nothing, so by
    default such rows count as good.
    """
    failed = F.size("failed_rules") > 0
    return failed if strict_null_keys else failed & F.col(key).isNotNull()


def split_good_bad(
    checked: DataFrame, key: str = "drug_id", strict_null_keys: bool = False
) -> tuple[DataFrame, DataFrame]:
    bad = is_bad(key, strict_null_keys)
    return checked.where(~bad), checked.where(bad)


def failing_keys(checked: DataFrame, key: str = "drug_id") -> DataFrame:
    return checked.where(F.size("failed_rules") > 0).select(key).distinct()


def keep_listed(df: DataFrame, keys: DataFrame, key: str = "drug_id") -> DataFrame:
    """Rows whose key is in a table of keys."""
    return df.join(keys, key, "left_semi")


def drop_listed(df: DataFrame, keys: DataFrame, key: str = "drug_id") -> DataFrame:
    """Rows whose key is not in a table of keys; rows without key stay."""
    return df.join(keys, key, "left_anti")


def rule_summary(checked: DataFrame) -> DataFrame:
    return (
        checked.select(F.explode("failed_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("row_count"))
    )


def quality_summary(checked: DataFrame, key: str = "drug_id", strict_null_keys: bool = False) -> DataFrame:
    bad = is_bad(key, strict_null_keys)
    return checked.agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad")
    )


def report_sample(df: DataFrame, cols: list[str], order_by: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` rows in key order, cut to one line of 120 characters per cell."""
    return df.orderBy(*order_by).limit(k).select(*[preview(F.col(c), 120, ellipsis=False).alias(c) for c in cols])


def summary_rows(lines: DataFrame, order_by: str) -> DataFrame:
    """The last row per metric key of a summary table.

    The key is the first filled of ``metric``, ``rule`` and ``name``, else ``row``.
    """
    have = [F.nullif(F.col(c), F.lit("")) for c in ("metric", "rule", "name") if c in lines.columns]
    keyed = lines.withColumn("_key", F.coalesce(*have, F.lit("row")))
    cols = [c for c in lines.columns if c != order_by]
    last = keyed.groupBy("_key").agg(F.max_by(F.struct(*cols), order_by).alias("r"))
    return last.select(F.col("_key").alias("summary_key"), *[F.col(f"r.{c}").alias(c) for c in cols])


def markdown_table(rows: list, headers: list[str]) -> str:
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(headers) + " |", "|" + "|".join("---" for _ in headers) + "|", *body])


def report_markdown(
    checked: DataFrame,
    cols: list[str],
    stamp: str,
    paths: dict[str, str],
    order_by: list[str],
    key: str = "drug_id",
) -> str:
    """Promotion report: counts, failures per rule, and up to ten rows of each side."""
    good, bad = split_good_bad(checked, key)
    counts = quality_summary(checked, key).first()
    rules = rule_summary(checked).orderBy("rule").collect()
    good_rows = report_sample(good, cols, order_by).collect()
    bad_rows = report_sample(bad, cols, order_by).collect()
    parts = ["# Quality promotion report", "", f"- Timestamp: **{stamp}**"]
    parts += [f"- {what}: `{path}`" for what, path in paths.items()]
    parts += ["", "## Row counts", f"- Total rows: **{counts['total']}**"]
    parts += [f"- Good rows: **{counts['good']}**", f"- Bad rows: **{counts['bad']}**", ""]
    parts += ["## Failures per rule", markdown_table(rules, ["rule", "row_count"]), ""]
    parts += ["## Sample good rows", markdown_table(good_rows, cols), "", "## Sample bad rows"]
    parts += [markdown_table(bad_rows, cols) if bad_rows else "_No bad rows._"]
    return "\n".join(parts)
