"""Profiling queries (A, W7-W10, P16)."""

from pyspark.sql import functions as F

from sievewell.operators import profile as pr
from sievewell.operators.ranking import certified_quantiles, hash_rank_key
from sievewell.plans.base import plan, table
from sievewell.plans.frames import SILVER_SQL, silver


@plan(
    "mass_bin_counts",
    "A1 TR1",
    f"""WITH s AS ({SILVER_SQL})
    SELECT CASE WHEN avg_mass < 100 THEN '<100' WHEN avg_mass BETWEEN 100 AND 500 THEN '100-500' ELSE '>500' END AS mass_bin,
           count(*) AS row_count FROM s GROUP BY 1""",
)
def mass_bin_counts(spark, sf):
    return pr.bin_counts(silver(spark, sf), "avg_mass")


@plan(
    "price_bin_counts",
    "A1",
    """SELECT CASE WHEN value < 100 THEN '<100' WHEN value BETWEEN 100 AND 500 THEN '100-500' ELSE '>500' END AS value_bin,
       count(*) AS row_count FROM events GROUP BY 1""",
)
def price_bin_counts(spark, sf):
    return pr.bin_counts(table(spark, sf, "events"), "value", "value_bin")


@plan(
    "top_indications",
    "A2",
    f"""WITH s AS ({SILVER_SQL}) SELECT indication, count(*) AS row_count FROM s GROUP BY 1
    ORDER BY row_count DESC, indication NULLS FIRST LIMIT 5""",
)
def top_indications(spark, sf):
    return pr.top_k(silver(spark, sf), "indication", 5)


@plan(
    "top_names_labelled",
    "A3",
    f"""WITH s AS ({SILVER_SQL}) SELECT CASE WHEN drug_name IS NULL OR drug_name = 'NULL' THEN '[NULL]' ELSE drug_name END AS drug_name,
    count(*) AS row_count FROM s GROUP BY 1 ORDER BY row_count DESC, 1 LIMIT 10""",
)
def top_names_labelled(spark, sf):
    return pr.top_k(silver(spark, sf), "drug_name", 10, "[NULL]", ("NULL",))


@plan(
    "daily_stats",
    "A4 P11",
    """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS row_count,
       round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value FROM events GROUP BY 1""",
)
def daily_stats(spark, sf):
    d = pr.daily_stats(table(spark, sf, "events"), "ts", "value")
    return d.select(
        F.col("day").cast("string").alias("day"),
        "row_count",
        F.round("mean_value", 6).alias("mean_value"),
        F.round("std_value", 6).alias("std_value"),
    )


@plan(
    "percentiles_exact",
    "A5",
    """SELECT p, round(v, 6) AS value FROM (
       SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS p,
              unnest(quantile_cont(l_extendedprice, [0.5, 0.9, 0.99])) AS v FROM lineitem)""",
)
def percentiles_exact(spark, sf):
    d = pr.percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.99])
    return d.select("p", F.round("value", 6).alias("value"))


@plan("percentiles_approximate", "A5")
def percentiles_approximate(spark, sf):
    return pr.percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.99], exact=False)


@plan("percentiles_certified", "A5", "SELECT p::DOUBLE AS p, count(l_extendedprice) AS n, true AS certified FROM lineitem, (VALUES (0.5), (0.9), (0.99)) t(p) GROUP BY p")
def percentiles_certified(spark, sf):
    """Sketched percentiles whose exact ranks are counted: each lies within the sketch's error."""
    d = certified_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.99])
    return d.select("p", "n", "certified")


_NULLABLE = ["drug_id", "drug_name", "avg_mass", "description", "indication", "mechanism", "toxicity", "ingest_dt"]


@plan(
    "null_rates",
    "A6",
    f"WITH s AS ({SILVER_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE AS null_rate FROM s"
        for c in _NULLABLE
    ),
)
def null_rates(spark, sf):
    return pr.null_rates(silver(spark, sf), _NULLABLE)


@plan(
    "mechanism_coverage",
    "A7",
    f"""WITH s AS ({SILVER_SQL}) SELECT CASE WHEN mechanism IS NULL THEN 'Missing Mechanism' ELSE 'With Mechanism' END AS bucket,
    count(*) AS row_count, count(*)::DOUBLE / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1""",
)
def mechanism_coverage(spark, sf):
    return pr.coverage(silver(spark, sf), "mechanism", "With Mechanism", "Missing Mechanism")


@plan(
    "duplicate_ids",
    "A8",
    f"WITH s AS ({SILVER_SQL}) SELECT drug_id, count(*) AS row_count FROM s GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    return pr.duplicate_keys(silver(spark, sf), "drug_id")


@plan(
    "feature_summary",
    "A11 T-11 T-12 T-13",
    f"""WITH s AS ({SILVER_SQL}) SELECT round(avg(length(drug_name)), 6) AS avg_name_length,
    round(avg(len(string_split_regex(description, '\\s+'))), 6) AS avg_desc_length,
    sum(CASE WHEN toxicity IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS sum_has_toxicity_info,
    sum(CASE WHEN contains(lower(mechanism), 'agonist') THEN 1 ELSE 0 END)::BIGINT AS sum_mech_agonist,
    sum(CASE WHEN contains(lower(mechanism), 'inhibitor') THEN 1 ELSE 0 END)::BIGINT AS sum_mech_inhibitor,
    sum(CASE WHEN contains(lower(mechanism), 'antagonist') THEN 1 ELSE 0 END)::BIGINT AS sum_mech_antagonist,
    count(*) AS total FROM s""",
)
def feature_summary(spark, sf):
    from sievewell.operators.features import engineered

    d = pr.feature_summary(
        engineered(silver(spark, sf)),
        ["name_length", "desc_length"],
        ["has_toxicity_info", "mech_agonist", "mech_inhibitor", "mech_antagonist"],
    )
    return d.withColumns({c: F.round(c, 6) for c in ("avg_name_length", "avg_desc_length")})


_CORR = ["avg_mass", "avg_mass_norm", "ingest_dt_ordinal", "description_len", "indication_len", "mechanism_len"]


@plan(
    "correlation_matrix",
    "A15 P16",
    f"""WITH s AS ({SILVER_SQL}), f AS (
      SELECT avg_mass, (avg_mass - (SELECT avg(avg_mass) FROM s)) / (SELECT stddev_samp(avg_mass) FROM s) AS avg_mass_norm,
             date_diff('day', DATE '1970-01-01', TRY_CAST(trim(ingest_dt) AS DATE)) + 719163 AS ingest_dt_ordinal,
             length(description) AS description_len, coalesce(length(indication), 4) AS indication_len,
             coalesce(length(mechanism), 4) AS mechanism_len FROM s)
    """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS correlation FROM f"
        for a in _CORR
        for b in _CORR
    ),
)
def correlation_matrix(spark, sf):
    from sievewell.operators.features import numeric_features

    d = pr.correlation(numeric_features(silver(spark, sf)), _CORR)
    return d.withColumn("correlation", F.round("correlation", 6))


@plan(
    "lineitem_correlation",
    "A15",
    " UNION ALL ".join(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
        for a in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ),
)
def lineitem_correlation(spark, sf):
    d = pr.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return d.withColumn("correlation", F.round("correlation", 6))


def _histogram_sql(src: str, col: str, n: int) -> str:
    return f"""WITH e AS (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {src}),
    c AS (SELECT least(floor(({col}::DOUBLE - lo) / (hi - lo) * {n}), {n - 1})::BIGINT AS bin, count(*) AS row_count
          FROM {src}, e WHERE {col} IS NOT NULL GROUP BY 1)
    SELECT r.bin, round(lo + (hi - lo) * r.bin / {n}, 6) AS lower, round(lo + (hi - lo) * (r.bin + 1) / {n}, 6) AS upper,
           coalesce(c.row_count, 0) AS row_count
    FROM (SELECT range AS bin FROM range({n})) r CROSS JOIN e LEFT JOIN c ON c.bin = r.bin"""


@plan("price_histogram", "A16", _histogram_sql("lineitem", "l_extendedprice", 50))
def price_histogram(spark, sf):
    d = pr.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)
    return d.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@plan("event_value_histogram", "A16", _histogram_sql("events", "value", 30))
def event_value_histogram(spark, sf):
    d = pr.histogram(table(spark, sf, "events"), "value", 30)
    return d.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@plan(
    "auto_insights",
    "A17",
    f"""WITH s AS ({SILVER_SQL}), r AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE AS r FROM s" for c in _NULLABLE
    )
    + """)
    (SELECT 'highest_null_pct' AS insight, c AS subject, round(r * 100, 2) AS value FROM r ORDER BY r DESC, c DESC LIMIT 1)
    UNION ALL SELECT 'p' || p, 'avg_mass', round(v, 6) FROM (SELECT unnest([50, 90, 99]) AS p,
       unnest(quantile_cont(avg_mass, [0.5, 0.9, 0.99])) AS v FROM s)
    UNION ALL SELECT 'missing_pct', 'mechanism', round(100 * avg(CASE WHEN mechanism IS NULL THEN 1.0 ELSE 0.0 END), 1) FROM s
    UNION ALL (SELECT 'most_common', coalesce(nullif(indication, 'NULL'), '[NULL]'), count(*)::DOUBLE FROM s GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""",
)
def auto_insights(spark, sf):
    d = pr.insights(silver(spark, sf).select(*_NULLABLE), "avg_mass", "mechanism", "indication")
    return d.withColumn("value", F.round("value", 6))


@plan(
    "table_summary",
    "A19",
    """SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count,
    'struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>' AS schema
    FROM orders""",
)
def table_summary(spark, sf):
    return pr.table_summary(table(spark, sf, "orders"), "orders")


@plan(
    "stratified_sample_hash",
    "W7",
    """SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice < 100 THEN '<100' WHEN p_retailprice <= 500 THEN '100-500' ELSE '>500' END AS stratum
    FROM part WHERE ('0x' || substr(md5('42|' || p_partkey), 1, 15))::BIGINT < 115292150460684704""",
)
def stratified_sample_hash(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return pr.stratified_sample(parts, pr.mass_bin(F.col("p_retailprice")), 0.1, 42, "p_partkey")


@plan("stratified_sample_seeded", "W7")
def stratified_sample_seeded(spark, sf):
    parts = table(spark, sf, "part").withColumn("mass_bin", pr.mass_bin(F.col("p_retailprice")))
    return pr.seeded_sample_by(parts, "mass_bin", {"<100": 0.1, "100-500": 0.1, ">500": 0.1}, 42)


@plan("plain_sample_hash", "W8", "SELECT p_partkey, p_retailprice FROM part WHERE ('0x' || substr(md5('7|' || p_partkey), 1, 15))::BIGINT < 288230376151711744")
def plain_sample_hash(spark, sf):
    """A quarter of the rows, by a hash of the id: the same rows however the table is laid out."""
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return parts.where(hash_rank_key(7, "p_partkey") < (1 << 60) // 4)


@plan("plain_sample", "W8")
def plain_sample(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").sample(False, 0.25, 7)


@plan(
    "ordered_readout",
    "W10",
    "SELECT p_type, count(*) AS row_count FROM part GROUP BY 1 ORDER BY p_type",
)
def ordered_readout(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("row_count")).orderBy("p_type")
