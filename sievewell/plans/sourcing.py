"""Source and sink queries (S, K, P1-P3, P8, P9): write derived data, read it back."""

from functools import cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewell.operators import standardize as st
from sievewell.plans.base import data_version, plan, table, text_table
from sievewell.plans.frames import MESSAGES_SQL, SILVER_SQL, messages, silver
from sievewell.session import work_dir
from sievewell.sources import files as fs
from sievewell.sources import incremental as inc
from sievewell.sources import records as rec
from sievewell.sources import sinks

# --- XML --------------------------------------------------------------------------


@cache
def _xml(app_id: str, version: str, spark, sf: str) -> str:
    """Parts as nested XML records: ids in both orders, some unflagged, nested row tags inside."""
    p = text_table(spark, sf, "part")
    key = F.col("p_partkey")
    ident = lambda prefix, primary: F.struct(
        F.concat(F.lit(prefix), key.cast("string")).alias("_VALUE"), primary.alias("_primary")
    )
    flag, none = F.lit(True), F.lit(None).cast("boolean")
    ids = (
        F.when(key % 5 == 0, F.array(ident("ALT", none), ident("DB", none)))
        .when(key % 2 == 0, F.array(ident("ALT", none), ident("DB", flag)))
        .otherwise(F.array(ident("DB", flag), ident("ALT", none)))
    )
    text = lambda c: F.array(F.concat(c, F.lit(" one")), F.concat(c, F.lit(" two")))
    drugs = p.select(
        ids.alias("drugbank-id"),
        F.col("p_name").alias("name"),
        F.when(key % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("average-mass"),
        F.when(key % 11 != 0, F.concat(F.lit("A part of type "), "p_type")).alias("description"),
        F.when(key % 13 != 0, F.col("p_brand")).alias("indication"),
        F.when(key % 11 != 0, F.concat(F.lit("made as "), "p_type")).alias("mechanism-of-action"),
        F.lit(None).cast("string").alias("toxicity"),
        F.col("p_type").alias("state"),
        F.struct(F.array(F.lit("approved"), F.col("p_type")).alias("group")).alias("groups"),
        F.struct(text(F.col("p_name")).alias("synonym")).alias("synonyms"),
        F.struct(F.transform(text(F.col("p_brand")), lambda c: F.struct(c.alias("category"))).alias("category")).alias("categories"),
        F.when(key % 11 != 0, F.struct(text(F.lit("Avoid")).alias("food-interaction"))).alias("food-interactions"),
        F.when(key % 11 != 0, F.struct(F.transform(text(F.col("p_type")), lambda d: F.struct(d.alias("description"))).alias("drug-interaction"))).alias("drug-interactions"),
        F.struct(F.struct(F.array(F.struct(F.lit("inner").alias("name"), F.lit("x").alias("note"))).alias("drug")).alias("drugs")).alias("pathways"),
    )
    path = work_dir(spark, "xml")
    drugs.write.format("xml").option("rootTag", "drugbank").option("rowTag", "drug").save(path)
    return path


def xml_path(spark, sf):
    return _xml(spark.sparkContext.applicationId, data_version(spark, sf, "part"), spark, sf)


_ID_SQL = "CASE WHEN p_partkey % 5 = 0 THEN 'ALT' || p_partkey ELSE 'DB' || p_partkey END"


@plan(
    "xml_standardized",
    "S1 P1 P3 TR20",
    f"""SELECT {_ID_SQL} AS drug_id, p_name AS drug_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS avg_mass,
    CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS indication, CASE WHEN p_partkey % 11 <> 0 THEN 'made as ' || p_type END AS mechanism FROM part""",
)
def xml_standardized(spark, sf):
    raw = fs.read_xml(spark, xml_path(spark, sf), "drug", schema=rec.RECORD_SCHEMA)
    d = st.standardize(raw, F.lit("2025-01-01").cast("date"))
    return d.select("drug_id", "drug_name", "avg_mass", "indication", "mechanism")


@plan(
    "xml_flattened_ids",
    "P2 S1",
    """SELECT 'DB' || p_partkey AS drug_id, p_name AS drug_name FROM part UNION ALL SELECT 'ALT' || p_partkey, p_name FROM part""",
)
def xml_flattened_ids(spark, sf):
    raw = fs.read_xml(spark, xml_path(spark, sf), "drug", schema=rec.RECORD_SCHEMA).withColumnRenamed("name", "drug_name")
    return st.flatten_ids(raw, "`drugbank-id`", ["drug_name"]).select("drug_id", "drug_name")


_MINI = (
    "`drugbank-id` STRUCT<_VALUE: STRING>, name STRING, state STRING, groups STRUCT<`group`: ARRAY<STRING>>"
)


@plan(
    "xml_fixed_schema",
    "S2",
    "SELECT p_name AS name, p_type AS state, 'approved|' || p_type AS groups FROM part",
)
def xml_fixed_schema(spark, sf):
    d = fs.read_xml(spark, xml_path(spark, sf), "drug", schema=_MINI, exclude_attribute=True)
    return d.select("name", "state", F.array_join("groups.group", "|").alias("groups"))


@plan("xml_sampled_inference", "S3 A19", "SELECT count(*) AS row_count FROM part")
def xml_sampled_inference(spark, sf):
    return fs.read_xml(spark, xml_path(spark, sf), "drug", sampling_ratio=0.1).agg(F.count("*").alias("row_count"))


@plan(
    "evidence_records",
    "P7 P8 P9 P1 TR20 TR21",
    f"""SELECT {_ID_SQL} AS drug_id, p_name AS drug_name, 'A part of type ' || p_type AS description, p_type || ' one' || chr(10) || p_type || ' two' AS drug_interactions,
    'Avoid one' || chr(10) || 'Avoid two' AS food_interactions, p_name || ' one|' || p_name || ' two' AS synonyms, 'approved|' || p_type AS groups, p_brand || ' one|' || p_brand || ' two' AS categories
    FROM part WHERE p_partkey % 11 <> 0 UNION ALL
    SELECT {_ID_SQL}, p_name, '', '', '', p_name || ' one|' || p_name || ' two', 'approved|' || p_type, p_brand || ' one|' || p_brand || ' two'
    FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 13 <> 0""",
)
def evidence_records(spark, sf):
    d = rec.evidence_records(fs.read_xml(spark, xml_path(spark, sf), "drug", schema=rec.RECORD_SCHEMA), F.lit("2025-01-01"))
    return d.select(
        "drug_id", "drug_name", "description", "drug_interactions", "food_interactions",
        *[F.array_join(c, "|").alias(c) for c in ("synonyms", "groups", "categories")],
    )


@plan(
    "xml_record_sample",
    "S16 K7",
    f"""SELECT {_ID_SQL} AS primary_id, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 2 = 0 THEN 'ALT' || p_partkey || '|DB' || p_partkey ELSE 'DB' || p_partkey || '|ALT' || p_partkey END AS all_ids,
    p_name AS name, 'approved|' || p_type AS groups FROM part ORDER BY 1 LIMIT 200""",
)
def xml_record_sample(spark, sf):
    path = work_dir(spark, "xml-sample")
    sinks.write_jsonl(rec.sample_records(fs.read_xml(spark, xml_path(spark, sf), "drug", schema=rec.RECORD_SCHEMA)), path)
    back = fs.read_jsonl(spark, path, "primary_id string, all_ids array<string>, name string, groups array<string>")
    return back.select("primary_id", F.array_join("all_ids", "|").alias("all_ids"), "name", F.array_join("groups", "|").alias("groups"))


# --- tables and files ------------------------------------------------------------------


@plan("parquet_round_trip", "S4 S5 S6 K1 K2", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def parquet_round_trip(spark, sf):
    path = work_dir(spark, "orders")
    sinks.write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return fs.read_any(spark, path)


@plan(
    "landed_by_date",
    "K3 K4 P11",
    """SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS row_count FROM events GROUP BY 1
    UNION ALL SELECT 'landed 2025-01-01', count(*) FROM events""",
)
def landed_by_date(spark, sf):
    ev = table(spark, sf, "events")
    by_event, by_landing = work_dir(spark, "by-event-date"), work_dir(spark, "by-landing-date")
    sinks.overwrite_by_event_date(ev, "ts", by_event)
    sinks.append_landed(ev, by_landing, F.lit("2025-01-01"))
    count = lambda p, label: spark.read.parquet(p).groupBy(label.alias("dt")).agg(F.count("*").alias("row_count"))
    landed = F.concat(F.lit("landed "), F.col("dt").cast("string"))
    return count(by_event, F.col("dt").cast("string")).unionByName(count(by_landing, landed))


@plan(
    "preview_csv",
    "K5 S10",
    "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part ORDER BY part.p_partkey LIMIT 20",
)
def preview_csv(spark, sf):
    path = work_dir(spark, "preview") + ".csv"
    sinks.write_preview_csv(table(spark, sf, "part").select("p_partkey", "p_name"), path, ["p_partkey"])
    return fs.read_by_suffix(spark, path)


@plan("two_locations", "K6", "SELECT c_custkey, c_name, 2 AS copies FROM customer")
def two_locations(spark, sf):
    a, b = work_dir(spark, "copy-a"), work_dir(spark, "copy-b")
    sinks.write_both(table(spark, sf, "customer").select("c_custkey", "c_name"), a, b)
    both = spark.read.parquet(a).unionByName(spark.read.parquet(b))
    return both.groupBy("c_custkey", "c_name").agg(F.count("*").alias("copies"))


@plan(
    "jsonl_by_glob",
    "S7 K7",
    "SELECT event_id, event_type, value FROM events",
)
def jsonl_by_glob(spark, sf):
    path = work_dir(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
    return fs.read_jsonl(spark, f"{path}/*.json", "event_id bigint, event_type string, value double")


@plan(
    "enriched_jsonl",
    "S8",
    """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'enriched' WHEN doc_id % 3 = 1 THEN NULL ELSE source END AS summary, lang FROM documents WHERE doc_id % 7 <> 0""",
)
def enriched_jsonl(spark, sf):
    path = work_dir(spark, "enriched-jsonl")
    i = F.col("doc_id")
    raw = F.format_string('{"id": "%d", "summary": "%s", "lang": "%s"}', i, "source", "lang")
    line = (
        F.when(i % 7 == 0, F.concat(F.lit('{"raw": '), raw))
        .when(i % 3 == 0, F.concat(F.lit('{"raw": '), raw, F.lit(', "llm_enriched": {"summary": "enriched"}}')))
        .when(i % 3 == 1, F.concat(F.lit('{"raw": '), raw, F.lit(', "llm_enriched": {"summary": null}}')))
        .otherwise(raw)
    )
    table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "summary", "lang")])
    return fs.read_enriched_jsonl(spark, path, schema)


@plan(
    "prompt_lines",
    "S9",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS line FROM benchmark)
    SELECT CASE WHEN item_id % 4 = 0 THEN 1000000 + item_id ELSE line END AS prompt_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS query FROM n WHERE item_id % 9 <> 8""",
)
def prompt_lines(spark, sf):
    path = work_dir(spark, "prompts")
    i, text = F.col("item_id"), F.col("text")
    obj = lambda **kw: F.to_json(F.struct(*[c.alias(k) for k, c in kw.items()]))
    line = (
        F.when(i % 9 == 8, F.lit("{not json"))
        .when(i % 4 == 0, obj(prompt_id=i + 1000000, query=F.when(i % 5 == 0, "").otherwise(text)))
        .when(i % 5 == 0, obj(other=text))
        .when(i % 4 == 1, obj(prompt=text, text=F.lit("unused")))
        .otherwise(obj(text=text))
    )
    table(spark, sf, "benchmark").orderBy("item_id").select(line.alias("value")).write.text(path)
    return fs.read_prompts(spark, path).select("prompt_id", "query")


@plan("latest_batch", "S15", "SELECT 'second' AS batch, count(*) AS row_count FROM supplier")
def latest_batch(spark, sf):
    import time

    path = work_dir(spark, "batches")
    sinks.write_jsonl(table(spark, sf, "customer").select(F.lit("first").alias("batch")).coalesce(1), f"{path}/a")
    time.sleep(1.1)  # file times have a resolution of a second on some stores
    sinks.write_jsonl(table(spark, sf, "supplier").select(F.lit("second").alias("batch")).coalesce(1), f"{path}/b")
    newest = spark.read.schema("batch string").json(fs.latest_batch(spark, path))
    return newest.groupBy("batch").agg(F.count("*").alias("row_count"))


@plan(
    "ordered_fingerprint",
    "S14",
    """WITH lines AS (SELECT event_id // 4000 AS file, row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) - 1 AS place,
      props || '|' || event_id AS line FROM events),
    leaves AS (SELECT file, place // 1024 AS place, sha256(string_agg(sha256(line), '' ORDER BY place)) AS hash, count(*) AS n, sum(strlen(line) + 1) AS bytes FROM lines GROUP BY file, lines.place // 1024),
    tops AS (SELECT file, sum(n)::BIGINT AS line_count, sum(bytes)::BIGINT AS bytes, CASE WHEN count(*) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash FROM leaves GROUP BY file)
    SELECT file, line_count, bytes, sha256(hash || '|' || line_count || '|' || bytes) AS sha256 FROM tops""",
)
def ordered_fingerprint(spark, sf):
    """Files of 4 000 lines each, in the order of their events."""
    path = work_dir(spark, "ordered")
    lines = table(spark, sf, "events").select(F.floor(F.col("event_id") / 4000).alias("file"), "event_id", F.concat_ws("|", "props", "event_id").alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    d = fs.ordered_fingerprint(spark, path)
    return d.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file"), "line_count", "bytes", "sha256")


@plan(
    "source_fingerprint",
    "S14",
    """SELECT sum(octet_length(encode(text)))::BIGINT + count(*) AS bytes, count(*) AS line_count FROM (SELECT replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents)""",
)
def source_fingerprint(spark, sf):
    path = work_dir(spark, "fingerprint")
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    table(spark, sf, "documents").select(flat.alias("value")).write.text(path)
    hashed = fs.source_fingerprint(spark, path).where(F.length("sha256") == 64)
    lines = fs.line_fingerprint(spark, path).where(F.col("digest").isNotNull())
    return hashed.agg(F.sum("bytes").alias("bytes")).select(
        "bytes", lines.agg(F.sum("line_count")).scalar().alias("line_count")
    )


@plan(
    "incremental_pull",
    "S11 K10 TR12",
    """WITH m AS (SELECT max(o_orderdate) AS mark FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
    SELECT 'run 1' AS dt, count(*) AS row_count FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
    UNION ALL SELECT 'run 2', count(*) FROM orders, m WHERE o_orderdate > mark""",
)
def incremental_pull(spark, sf):
    state, out = work_dir(spark, "mark"), work_dir(spark, "pulled")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    early = orders.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    inc.pull(early, "o_orderdate", state, out, F.lit("run 1"))
    inc.pull(orders, "o_orderdate", state, out, F.lit("run 2"))
    inc.pull(orders, "o_orderdate", state, out, F.lit("run 3"))  # nothing new: the mark stays
    inc.pull(orders, "o_orderdate", state, out, F.lit("run 4"))
    return spark.read.parquet(out).groupBy("dt").agg(F.count("*").alias("row_count"))


@plan(
    "promoted_tables",
    "K11 Q9",
    f"""WITH s AS ({SILVER_SQL}) SELECT 'canonical' AS place, count(*) FILTER (avg_mass > 0) AS row_count FROM s
    UNION ALL SELECT 'archive', count(*) FILTER (NOT coalesce(avg_mass > 0, false)) FROM s""",
)
def promoted_tables(spark, sf):
    canonical, archive = work_dir(spark, "canonical"), work_dir(spark, "archive")
    s = silver(spark, sf)
    ok = F.coalesce(F.col("avg_mass") > 0, F.lit(False))
    sinks.promote(s.where(ok), s.where(~ok), canonical, archive, "20250101_000000")
    count = lambda p, name: spark.read.parquet(p).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("place"), "row_count")
    return count(canonical, "canonical").unionByName(count(f"{archive}/bad_20250101_000000", "archive"))


@plan(
    "evidence_manifest",
    "K12 S14",
    """SELECT 'b1' AS build_id, count(*) AS row_count, 'v2' AS schema_version, 12 AS fields, true AS hash_follows_source
    FROM part WHERE p_partkey % 11 <> 0 OR p_partkey % 13 <> 0""",
)
def evidence_manifest(spark, sf):
    """Evidence records of the XML source with a manifest that holds the hash of that source."""
    built, path, source = work_dir(spark, "evidence"), work_dir(spark, "manifest"), xml_path(spark, sf)
    raw = fs.read_xml(spark, source, "drug", schema=rec.RECORD_SCHEMA)
    sinks.write_table(rec.evidence_records(raw, F.lit("2025-01-01")), built)
    digest = fs.folder_fingerprint(spark, source)
    sinks.write_manifest(sinks.manifest_frame(spark, built, "b1", "2025-01-01T00:00:00", digest, source), path)
    m = spark.read.json(path, schema="build_id string, row_count bigint, schema_version string, source_xml_hash string, fields_in_chunk_basis array<string>")
    other = fs.folder_fingerprint(spark, built_as_text(spark, built))
    follows = (F.length("source_xml_hash") == 64) & (F.col("source_xml_hash") == digest) & (F.col("source_xml_hash") != other)
    return m.select("build_id", "row_count", "schema_version", F.size("fields_in_chunk_basis").alias("fields"), follows.alias("hash_follows_source"))


def built_as_text(spark, built: str) -> str:
    """Another set of files, whose hash must differ."""
    path = work_dir(spark, "evidence-text")
    spark.read.parquet(built).select(F.col("drug_id").alias("value")).write.text(path)
    return path


@plan("registered_view", "K13", "SELECT event_type, count(*) AS row_count FROM events GROUP BY 1")
def registered_view(spark, sf):
    sinks.register(table(spark, sf, "events"), "registered_events")
    return spark.sql("SELECT event_type, count(*) AS row_count FROM registered_events GROUP BY event_type")
