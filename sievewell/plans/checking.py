"""Quality-rule queries (Q, J1, J2, A9, A10, A18, U1, U3)."""

from pyspark.sql import functions as F

from sievewell.operators import quality as q
from sievewell.plans.base import plan
from sievewell.plans.frames import SILVER_SQL, silver
from sievewell.session import work_dir, written_once
from sievewell.sources import files as fs
from sievewell.sources import sinks

# One row per input row with a flag per rule, for the SQL side.
FLAGS_SQL = f"""
s AS ({SILVER_SQL}),
b AS (SELECT quantile_cont(avg_mass, 0.25) AS q1, quantile_cont(avg_mass, 0.75) AS q3 FROM s),
d AS (SELECT drug_id FROM s WHERE drug_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT s.*,
  coalesce(drug_name IS NULL OR length(trim(drug_name)) = 0, false) AS name_missing,
  drug_id IS NULL AS id_missing,
  coalesce(drug_id IN (SELECT drug_id FROM d), false) AS id_duplicate,
  coalesce(NOT regexp_matches(drug_id, '^DB\\d+$'), false) AS id_pattern,
  coalesce(avg_mass IS NULL OR avg_mass <= 0 OR avg_mass >= 1000000, false) AS mass_invalid,
  coalesce(length(trim(indication)) < 10 OR length(trim(mechanism)) < 10, false) AS text_short,
  coalesce(ingest_dt IS NULL OR length(trim(ingest_dt)) = 0, false) AS ingest_missing,
  coalesce(avg_mass < q1 - 1.5 * (q3 - q1) OR avg_mass > q3 + 1.5 * (q3 - q1), false) AS mass_outlier
FROM s, b),
c AS (SELECT *, name_missing OR id_missing OR id_duplicate OR id_pattern OR mass_invalid OR text_short
   OR ingest_missing OR mass_outlier AS any_failed FROM f)
"""
RULES = [
    "name_missing", "id_missing", "id_duplicate", "id_pattern",
    "mass_invalid", "text_short", "ingest_missing", "mass_outlier",
]


def checked(spark, sf):
    return q.evaluate_rules(q.require_columns(silver(spark, sf)))


@plan(
    "failed_rules_per_row",
    "Q0 Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 TR2",
    f"WITH {FLAGS_SQL} SELECT k, concat_ws('|', "
    + ", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in RULES)
    + ") AS failed_rules FROM c",
)
def failed_rules_per_row(spark, sf):
    return checked(spark, sf).select("k", F.array_join("failed_rules", "|").alias("failed_rules"))


@plan(
    "rule_failure_counts",
    "Q9",
    f"WITH {FLAGS_SQL} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS row_count FROM c" for r in RULES)
    + ") WHERE row_count > 0",
)
def rule_failure_counts(spark, sf):
    return q.rule_summary(checked(spark, sf))


@plan(
    "quality_summary",
    "Q9 A9 TR3",
    f"""WITH {FLAGS_SQL} SELECT count(*) AS total, count(*) FILTER (NOT (any_failed AND drug_id IS NOT NULL)) AS good,
    count(*) FILTER (any_failed AND drug_id IS NOT NULL) AS bad FROM c""",
)
def quality_summary(spark, sf):
    return q.quality_summary(checked(spark, sf))


@plan(
    "quality_summary_strict",
    "Q9 TR3",
    f"""WITH {FLAGS_SQL} SELECT count(*) AS total, count(*) FILTER (NOT any_failed) AS good,
    count(*) FILTER (any_failed) AS bad FROM c""",
)
def quality_summary_strict(spark, sf):
    return q.quality_summary(checked(spark, sf), strict_null_keys=True)


@plan("good_rows", "J2 Q9", f"WITH {FLAGS_SQL} SELECT k, drug_id FROM c WHERE NOT any_failed OR drug_id IS NULL")
def good_rows(spark, sf):
    return q.split_good_bad(checked(spark, sf))[0].select("k", "drug_id")


@plan(
    "bad_rows_by_key",
    "J1 A18 U1 U3",
    f"WITH {FLAGS_SQL} SELECT k, drug_id FROM s WHERE drug_id IN (SELECT drug_id FROM c WHERE any_failed)",
)
def bad_rows_by_key(spark, sf):
    c = written_once(checked(spark, sf), "checked")
    return q.keep_listed(c, q.failing_keys(c)).select("k", "drug_id")


@plan(
    "good_rows_by_key",
    "J2 TR3",
    f"""WITH {FLAGS_SQL} SELECT k, drug_id FROM s
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE any_failed AND c.drug_id = s.drug_id)""",
)
def good_rows_by_key(spark, sf):
    c = written_once(checked(spark, sf), "checked")
    return q.drop_listed(c, q.failing_keys(c)).select("k", "drug_id")


@plan("failing_keys", "A18", f"WITH {FLAGS_SQL} SELECT DISTINCT drug_id FROM c WHERE any_failed")
def failing_keys(spark, sf):
    return q.failing_keys(checked(spark, sf))


@plan(
    "iqr_fences",
    "Q8",
    f"""WITH {FLAGS_SQL} SELECT round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM b""",
)
def iqr_fences(spark, sf):
    lower, upper = q.iqr_bounds(silver(spark, sf), "avg_mass")
    return spark.createDataFrame([(round(lower, 6), round(upper, 6))], "lower double, upper double")


@plan(
    "report_bad_sample",
    "Q10 P14 W9",
    f"""WITH {FLAGS_SQL} SELECT coalesce(drug_id, '') AS drug_id, substr(coalesce(drug_name, ''), 1, 120) AS drug_name,
    coalesce(ingest_dt, '') AS ingest_dt FROM c WHERE any_failed AND drug_id IS NOT NULL ORDER BY drug_id, k LIMIT 10""",
)
def report_bad_sample(spark, sf):
    bad = q.split_good_bad(checked(spark, sf))[1]
    return q.report_sample(bad, ["drug_id", "drug_name", "ingest_dt"], ["drug_id", "k"])


@plan(
    "report_good_sample",
    "Q10 P14 W9",
    f"""WITH {FLAGS_SQL} SELECT coalesce(drug_id, '') AS drug_id, substr(coalesce(drug_name, ''), 1, 120) AS drug_name,
    coalesce(ingest_dt, '') AS ingest_dt FROM c WHERE NOT any_failed ORDER BY drug_id, k LIMIT 10""",
)
def report_good_sample(spark, sf):
    good = q.split_good_bad(checked(spark, sf), strict_null_keys=True)[0]
    return q.report_sample(good, ["drug_id", "drug_name", "ingest_dt"], ["drug_id", "k"])


@plan(
    "promoted_by_rules",
    "K11 Q9 Q10",
    f"""WITH {FLAGS_SQL} SELECT 'canonical' AS place, count(*) FILTER (NOT any_failed OR drug_id IS NULL) AS row_count FROM c
    UNION ALL SELECT 'archive', count(*) FILTER (any_failed AND drug_id IS NOT NULL) FROM c
    UNION ALL SELECT 'published', count(*) FILTER (NOT any_failed OR drug_id IS NULL) FROM c""",
)
def promoted_by_rules(spark, sf):
    """Standardised rows, checked, promoted and published, and what each place then holds."""
    canonical, archive, published = (work_dir(spark, f"promoted-{x}") for x in ("canonical", "archive", "published"))
    good, bad = q.split_good_bad(written_once(checked(spark, sf), "checked"))
    sinks.promote(good, bad, canonical, archive, "20250101_000000", published, "parquet")
    count = lambda p, name: spark.read.parquet(p).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("place"), "row_count")
    parts = count(canonical, "canonical").unionByName(count(f"{archive}/bad_20250101_000000", "archive"))
    return parts.unionByName(count(published, "published"))


@plan(
    "summary_directory",
    "A10 S10",
    f"""WITH {FLAGS_SQL} SELECT rule AS summary_key, row_count::VARCHAR AS row_count FROM ("""
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS row_count FROM c" for r in RULES)
    + ") WHERE row_count > 0",
)
def summary_directory(spark, sf):
    """The failures of each rule written as a directory of CSV files and read back."""
    path = work_dir(spark, "summary")
    q.rule_summary(checked(spark, sf)).withColumn("line", F.monotonically_increasing_id()).write.option("header", True).csv(f"{path}/summary.csv")
    lines = fs.read_by_suffix(spark, f"{path}/summary.csv")
    return q.summary_rows(lines.withColumn("line", F.col("line").cast("bigint")), "line").select("summary_key", "row_count")


@plan(
    "summary_last_rows",
    "A10",
    f"""WITH {FLAGS_SQL}, l AS (SELECT row_number() OVER (ORDER BY k) AS line, CASE WHEN k % 4 = 0 THEN '' ELSE o END AS metric, k AS value
      FROM (SELECT k, coalesce(indication, '') AS o FROM s))
    SELECT coalesce(nullif(metric, ''), 'row') AS summary_key, arg_max(metric, value) AS metric, max(value) AS value FROM l GROUP BY 1""",
)
def summary_last_rows(spark, sf):
    lines = silver(spark, sf).select(
        F.col("k").alias("line"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.coalesce("indication", F.lit(""))).alias("metric"),
        F.col("k").alias("value"),
    )
    return q.summary_rows(lines, "line")
