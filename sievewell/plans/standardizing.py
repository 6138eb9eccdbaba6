"""Standardising queries (P, U, J3)."""

from pyspark.sql import functions as F

from sievewell.operators import standardize as st
from sievewell.plans.base import plan, table
from sievewell.plans.frames import MESSAGES_SQL, SILVER_SQL, messages, silver


@plan(
    "dedupe_by_id",
    "P4 P3",
    f"""WITH s AS ({SILVER_SQL}) SELECT drug_id, k, trim(drug_name) AS drug_name FROM s
    QUALIFY row_number() OVER (PARTITION BY drug_id ORDER BY k) = 1""",
)
def dedupe_by_id(spark, sf):
    s = silver(spark, sf).select("drug_id", "k", F.trim("drug_name").alias("drug_name"))
    return st.dedupe(s, "drug_id", ["k"])


@plan(
    "dedupe_counts",
    "P4",
    f"""WITH s AS ({SILVER_SQL}), g AS (SELECT drug_id, count(*) AS n FROM s GROUP BY 1)
    SELECT sum(n)::BIGINT AS rows_before, count(*) AS rows_after, sum(n - 1)::BIGINT AS rows_removed FROM g""",
)
def dedupe_counts(spark, sf):
    return st.dedupe_counts(silver(spark, sf), "drug_id")


@plan(
    "alias_fill",
    "P5",
    f"""WITH s AS ({SILVER_SQL}) SELECT k,
    CASE WHEN length(trim(coalesce(mechanism, ''))) > 0 THEN mechanism END AS mechanism_of_action,
    CASE WHEN length(trim(coalesce(toxicity, ''))) > 0 THEN toxicity WHEN length(trim(coalesce(drug_name, ''))) > 0 THEN drug_name ELSE toxicity END AS toxicity FROM s""",
)
def alias_fill(spark, sf):
    s = silver(spark, sf).withColumn("toxicities", F.col("drug_name"))
    return st.coalesce_aliases(s).select("k", "mechanism_of_action", "toxicity")


@plan(
    "id_name_precedence",
    "P6",
    f"""WITH s AS ({SILVER_SQL}) SELECT k, coalesce(nullif(drug_id, ''), 'unknown') AS record_id,
    coalesce(nullif(drug_name, ''), 'Unknown') AS record_name FROM s""",
)
def id_name_precedence(spark, sf):
    s = silver(spark, sf)
    return s.select(
        "k",
        st.first_known(s, ["drugbank_id", "id", "drug_id"], "unknown").alias("record_id"),
        st.first_known(s, ["name", "drug_name"], "Unknown").alias("record_name"),
    )


@plan(
    "drop_empty_records",
    "P7",
    f"""WITH s AS ({SILVER_SQL}) SELECT k FROM s WHERE (length(trim(coalesce(toxicity, ''))) > 0 OR length(trim(coalesce(mechanism, ''))) > 0)
    AND drug_id IS NOT NULL AND length(trim(coalesce(drug_name, ''))) > 0""",
)
def drop_empty_records(spark, sf):
    return st.drop_empty_text(silver(spark, sf), ["toxicity", "mechanism"], ["drug_id", "drug_name"]).select("k")


_LINE = "trim(replace(x, chr(13), ''), ' ' || chr(9) || chr(10) || chr(12) || chr(11))"


@plan(
    "joined_child_texts",
    "P8 P9",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINE}), lambda x: x <> '') AS a FROM documents)
    SELECT doc_id, array_to_string(a, chr(10)) AS body, len(a) AS pieces FROM l""",
)
def joined_child_texts(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select(
        "doc_id", st.join_texts(lines).alias("body"), F.size(st.list_texts(lines)).cast("bigint").alias("pieces")
    )


@plan(
    "clean_messages",
    "P10 TR22",
    f"""WITH m AS ({MESSAGES_SQL}), j AS (SELECT event_id, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM m)
    SELECT event_id, v->>'$.id' AS id, CASE WHEN json_exists(v, '$.source') THEN v->>'$.source' ELSE 'unknown' END AS source,
           v->>'$.text' AS text, length(v->>'$.text') AS text_length, '2025-01-01T00:00:00' AS processed_at
    FROM j WHERE json_type(v, '$.text') = 'VARCHAR'""",
)
def clean_messages(spark, sf):
    return st.clean_messages(messages(spark, sf), "value", F.lit("2025-01-01T00:00:00"), ["event_id"])


@plan(
    "explorer_filter",
    "P12",
    f"""WITH s AS ({SILVER_SQL}) SELECT k, drug_name, avg_mass FROM s
    WHERE (contains(lower(drug_name), 'build') OR contains(lower(indication), 'build') OR contains(lower(mechanism), 'build'))
    AND avg_mass >= 1000 AND avg_mass <= 250000 AND length(mechanism) > 0""",
)
def explorer_filter(spark, sf):
    s = st.search_filter(
        silver(spark, sf), "Build", ["drug_name", "indication", "mechanism"], "avg_mass", 1000, 250000, "mechanism"
    )
    return s.select("k", "drug_name", "avg_mass")


@plan(
    "latest_rows",
    "P13 K13",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events ORDER BY events.ts DESC, event_id LIMIT 5",
)
def latest_rows(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("message_events")
    return spark.sql(
        "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts, event_type "
        "FROM message_events ORDER BY message_events.ts DESC, event_id LIMIT 5"
    )


@plan(
    "preview_text",
    "P14",
    """SELECT doc_id, CASE WHEN length(f) > 100 THEN substr(f, 1, 100) || '...' ELSE f END AS preview FROM (
    SELECT doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS f FROM documents)""",
)
def preview_text(spark, sf):
    from sievewell.functions.text import preview

    return table(spark, sf, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@plan(
    "null_to_empty",
    "P15",
    f"""WITH s AS ({SILVER_SQL}) SELECT k, coalesce(drug_name, '') AS drug_name, coalesce(toxicity, '') AS toxicity FROM s""",
)
def null_to_empty(spark, sf):
    return st.fill_and_limit(silver(spark, sf).select("k", "drug_name", "toxicity"), ["k"])


@plan(
    "first_records",
    "P15 W9",
    f"""WITH s AS ({SILVER_SQL}) SELECT k, coalesce(toxicity, '') AS toxicity FROM s ORDER BY k LIMIT 200""",
)
def first_records(spark, sf):
    return st.fill_and_limit(silver(spark, sf).select("k", "toxicity"), ["k"], 200)


@plan(
    "tolerant_casts",
    "P16",
    f"""WITH s AS ({SILVER_SQL}) SELECT k, TRY_CAST(drug_id AS DOUBLE) AS drug_id,
    strftime(TRY_CAST(trim(ingest_dt) AS DATE), '%Y-%m-%d') AS ingest_dt FROM s""",
)
def tolerant_casts(spark, sf):
    s = silver(spark, sf).select("k", "drug_id", "ingest_dt")
    return st.null_if_unreadable(s, {"drug_id": "double", "ingest_dt": "date"}).withColumn(
        "ingest_dt", F.col("ingest_dt").cast("string")
    )


@plan(
    "union_by_name",
    "U1 U2 U3",
    """SELECT DISTINCT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
    UNION SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_suppkey AS key")
    return c.unionByName(s, allowMissingColumns=True).distinct()
