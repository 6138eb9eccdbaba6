"""Enrichment queries (E, T-21, V7-V9)."""

from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.operators import enrich as en
from sievewell.operators import evaluate as ev
from sievewell.operators import prompts as pm
from sievewell.operators.guardrail import parse_answer
from sievewell.plans.base import plan
from sievewell.plans.frames import (
    ANSWERS_SQL,
    SILVER_SQL,
    answers,
    silver,
    sql_strip,
    sql_words,
)
from sievewell.plans.guarding import _q


def records(spark, sf):
    """The silver table under the names of raw records, with groups as a list."""
    return silver(spark, sf).select(
        "k",
        F.col("drug_id"),
        F.trim("drug_name").alias("name"),
        "description",
        "indication",
        F.col("mechanism").alias("mechanism_of_action"),
        "toxicity",
        F.when(F.col("k") % 4 == 0, F.array().cast("array<string>"))
        .when(F.col("k") % 9 == 0, F.array(F.lit("approved"), F.lit("Withdrawn")))
        .otherwise(F.array(F.lit("approved"), F.lit("vet")))
        .alias("groups"),
    )


RECORDS_SQL = f"""s AS ({SILVER_SQL}),
rec AS (SELECT k, drug_id, trim(drug_name) AS name, description, indication, mechanism AS mechanism_of_action, toxicity,
  CASE WHEN k % 4 = 0 THEN [] WHEN k % 9 = 0 THEN ['approved', 'Withdrawn'] ELSE ['approved', 'vet'] END AS groups FROM s),
src AS (SELECT *, coalesce(nullif(indication, ''), nullif(description, ''), '') AS ind, coalesce(nullif(mechanism_of_action, ''), '') AS mech,
  array_to_string(groups, ', ') AS gs FROM rec),
enr AS (SELECT *, coalesce(nullif(concat_ws(' ', CASE WHEN length(name) > 0 THEN name || ' is a drug in the DrugBank dataset.' END,
   CASE WHEN gs <> '' THEN 'It belongs to the following group(s): ' || gs || '.' END,
   CASE WHEN ind <> '' THEN 'Typical indications include: ' || substr(ind, 1, 200) END), ''), 'Information not specified in the source record.') AS summary,
   CASE WHEN ind <> '' THEN substr(ind, 1, 120) ELSE 'Not specified' END AS use1, CASE WHEN mech <> '' THEN substr(mech, 1, 240) ELSE 'Mechanism not specified.' END AS how FROM src)"""


def enriched(spark, sf):
    r = records(spark, sf)
    return en.dq_score(r.withColumn("enriched", en.fallback_enrichment(r)), "enriched", "name")


@plan("fallback_enrichment", "E1", f"WITH {RECORDS_SQL} SELECT k, summary, use1 AS primary_indication, how AS mechanism_summary FROM enr")
def fallback_enrichment(spark, sf):
    r = records(spark, sf)
    e = r.withColumn("e", en.fallback_enrichment(r))
    return e.select(
        "k", F.col("e.summary").alias("summary"), F.get("e.primary_indications", F.lit(0)).alias("primary_indication"),
        F.col("e.mechanism_summary").alias("mechanism_summary"),
    )


@plan(
    "enrichment_scores",
    "E2",
    f"""WITH {RECORDS_SQL}, g AS (SELECT *, (contains(lower(summary), 'not specified'))::INT + (contains(lower(how), 'not specified'))::INT + 1 AS hits,
       lower(summary || ' ' || how || ' Safety information not specified in the source record.') AS txt FROM enr)
    SELECT k, round(1.0::DOUBLE - 0.05 - 0.05 - CASE WHEN hits >= 2 THEN 0.1 ELSE 0.0 END
         - CASE WHEN coalesce(trim(name), '') <> '' AND NOT contains(txt, lower(trim(name))) THEN 0.05 ELSE 0.0 END, 6) AS dq_score,
      concat_ws('|', 'Field primary_indications has fewer than 2 items', 'Field tags has fewer than 3 items',
         CASE WHEN hits >= 2 THEN 'Multiple text fields rely on generic ''not specified'' style wording' END) AS field_issues FROM g""",
)
def enrichment_scores(spark, sf):
    return enriched(spark, sf).select(
        "k", F.round("dq_score", 6).alias("dq_score"), F.array_join("dq_field_issues", "|").alias("field_issues")
    )


# Answers seen as enrichment output, for scores on lists of several sizes and absent names.
@plan(
    "answer_scores",
    "E2",
    f"""WITH {ANSWERS_SQL}, p AS (SELECT *, CASE WHEN json_valid(content) THEN CASE WHEN json_type(content::JSON) = 'OBJECT' THEN content::JSON END END AS v FROM answers),
    f AS (SELECT conv_id, turn, question, CASE WHEN json_type(v, '$.summary') = 'VARCHAR' THEN v->>'$.summary' ELSE coalesce(v->>'$.summary', '') END AS s,
      coalesce(v->>'$.mechanism_summary', '') AS m, coalesce(v->>'$.safety_notes', '') AS n,
      coalesce(json_array_length(v, '$.primary_indications'), 0) AS ni, CASE WHEN json_type(v, '$.tags') = 'ARRAY' THEN json_array_length(v, '$.tags') ELSE 0 END AS nt FROM p WHERE v IS NOT NULL),
    h AS (SELECT *, (contains(lower(s), 'not specified') OR contains(lower(s), 'information not available'))::INT
      + (contains(lower(m), 'not specified'))::INT + (contains(lower(n), 'not specified'))::INT AS hits, {sql_strip('question')} AS nm FROM f)
    SELECT conv_id, turn, round(greatest(0.0, 1.0::DOUBLE - CASE WHEN {sql_strip('s')} = '' THEN 0.25 ELSE 0.0 END - CASE WHEN ni = 0 THEN 0.15 WHEN ni = 1 THEN 0.05 ELSE 0.0 END
      - CASE WHEN {sql_strip('m')} = '' THEN 0.2 ELSE 0.0 END - CASE WHEN {sql_strip('n')} = '' THEN 0.2 ELSE 0.0 END
      - CASE WHEN nt = 0 THEN 0.15 WHEN nt < 3 THEN 0.05 ELSE 0.0 END - CASE WHEN hits >= 2 THEN 0.1 ELSE 0.0 END
      - CASE WHEN nm <> '' AND NOT contains(lower(s || ' ' || m || ' ' || n), lower(nm)) THEN 0.05 ELSE 0.0 END), 6) AS dq_score FROM h""",
)
def answer_scores(spark, sf):
    from sievewell.operators.guardrail import typed_answer

    d = answers(spark, sf).withColumn("v", F.try_parse_json("content"))
    d = d.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    d = d.withColumn("e", typed_answer(F.col("v")))
    return en.dq_score(d, "e", "question").select("conv_id", "turn", F.round("dq_score", 6).alias("dq_score"))


_REQ = "concat_ws('|', " + ", ".join(
    f"""CASE WHEN NOT json_exists(v, '$.{f}') THEN 'Missing field: {f}' WHEN json_type(v, '$.{f}') = 'NULL' THEN 'Field {f} is None'
      WHEN json_type(v, '$.{f}') = 'VARCHAR' AND {sql_strip(f"(v->>'$.{f}')")} = '' THEN 'Field {f} is empty string'
      WHEN json_type(v, '$.{f}') = 'ARRAY' AND json_array_length(v, '$.{f}') = 0 THEN 'Field {f} is empty list' END"""
    for f in P.ENRICHED_FIELDS
) + ")"


def flagged(spark, sf):
    """Answers with red-flag phrases and empty fields worked into some of them."""
    n = F.col("n")
    text = (
        F.when(n % 5 == 0, F.concat(F.lit("It cures cancer and has no side effects. "), "answer"))
        .when(n % 7 == 0, F.lit(" "))
        .when(n % 9 == 0, F.lit("Completely safe for everyone, 100% safe"))
        .otherwise(F.col("answer"))
    )
    tags = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Works for all diseases"), F.lit("b")))
    obj = F.struct(
        text.alias("summary"),
        F.array(F.lit("pain")).alias("primary_indications"),
        F.when(n % 6 != 0, F.lit("works")).alias("mechanism_summary"),
        F.lit("ask").alias("safety_notes"),
        tags.alias("tags"),
    )
    return answers(spark, sf).select("conv_id", "turn", "n", F.to_json(obj).alias("content"))


FLAGGED_SQL = f"""{ANSWERS_SQL},
fl AS (SELECT conv_id, turn, n, CASE WHEN n % 5 = 0 THEN 'It cures cancer and has no side effects. ' || answer WHEN n % 7 = 0 THEN ' '
  WHEN n % 9 = 0 THEN 'Completely safe for everyone, 100% safe' ELSE answer END AS s, CASE WHEN n % 4 = 0 THEN [] ELSE ['Works for all diseases', 'b'] END AS tags FROM answers),
fj AS (SELECT conv_id, turn, n, CASE WHEN n % 6 = 0 THEN json_object('summary', s, 'primary_indications', ['pain'], 'safety_notes', 'ask', 'tags', tags)
  ELSE json_object('summary', s, 'primary_indications', ['pain'], 'mechanism_summary', 'works', 'safety_notes', 'ask', 'tags', tags) END AS v,
  lower(concat_ws(' ', s, 'pain', CASE WHEN n % 6 <> 0 THEN 'works' END, 'ask', CASE WHEN len(tags) > 0 THEN array_to_string(tags, ' ') END)) AS txt FROM fl),
fi AS (SELECT *, {_REQ} AS field_issues, concat_ws('|', {", ".join(f"CASE WHEN regexp_matches(txt, {_q(p)}) THEN {_q(f"Hallucination pattern matched: '{p}'")} END" for p in P.RED_FLAG_PATTERNS)}) AS halluc_issues FROM fj),
fs AS (SELECT *, CASE WHEN field_issues = '' THEN 0 ELSE len(string_split(field_issues, '|')) END AS nf, CASE WHEN halluc_issues = '' THEN 0 ELSE len(string_split(halluc_issues, '|')) END AS nh FROM fi)"""


@plan(
    "enriched_validity",
    "E3 E4 E6",
    f"""WITH {FLAGGED_SQL} SELECT conv_id, turn, field_issues, halluc_issues,
    round(greatest(0.0, 1.0::DOUBLE - 0.1 * (nf + nh) - CASE WHEN nf > 0 THEN 0.1 ELSE 0 END - CASE WHEN nh > 0 THEN 0.1 ELSE 0 END), 6) AS score,
    CASE WHEN nf = 0 AND nh = 0 THEN 1 ELSE 0 END AS valid FROM fs""",
)
def enriched_validity(spark, sf):
    d = flagged(spark, sf).withColumn("v", parse_answer(F.col("content")))
    d = en.validate_enriched(d, "v")
    return d.select(
        "conv_id", "turn", F.array_join("field_issues", "|").alias("field_issues"),
        F.array_join("hallucination_issues", "|").alias("halluc_issues"),
        F.round("score", 6).alias("score"), F.col("valid").cast("int").alias("valid"),
    )


@plan(
    "profile_checks",
    "D4 E4 E5",
    f"""WITH {ANSWERS_SQL}, o AS (SELECT conv_id, turn, n, 'X' AS drug_name, CASE WHEN n % 3 = 0 THEN NULL ELSE 'acts and is widely used' END AS mech,
      CASE WHEN n % 2 = 0 THEN 'list' ELSE 'text' END AS kind, CASE WHEN n % 5 = 0 THEN 'short' ELSE 'a first-line choice that has no side effects' END AS summary, CASE WHEN n % 4 = 0 THEN ' ' ELSE 'no risk' END AS warn, n % 7 = 0 AS withdrawn FROM answers)
    SELECT conv_id, turn, concat_ws('|', CASE WHEN mech IS NULL THEN 'Null value for field: mechanism_of_action' END, 'Missing field: contraindications',
       CASE WHEN warn = ' ' THEN 'Empty string for field: warnings' END, 'Missing field: safe_usage', CASE WHEN kind = 'text' THEN 'side_effects must be a list of strings' END,
       CASE WHEN length(summary) < 20 THEN 'summary is suspiciously short (<20 chars)' END) AS issues,
      concat_ws('|', CASE WHEN summary <> 'short' THEN 'Potential hallucination: contains phrase ''has no side effects''' END,
       CASE WHEN warn <> ' ' THEN 'Potential hallucination: contains phrase ''no risk''' END,
       CASE WHEN withdrawn AND (mech IS NOT NULL OR summary <> 'short') THEN 'Drug is withdrawn but LLM claims it''s widely used.' END) AS warnings FROM o""",
)
def profile_checks(spark, sf):
    from sievewell.operators.guardrail import profile_issues

    n = F.col("n")
    body = F.concat(
        F.lit('{"drug_name":"X","mechanism_of_action":'),
        F.when(n % 3 == 0, "null").otherwise('"acts and is widely used"'),
        F.lit(',"side_effects":'),
        F.when(n % 2 == 0, '["nausea"]').otherwise('"nausea"'),
        F.lit(',"warnings":'),
        F.when(n % 4 == 0, '" "').otherwise('"no risk"'),
        F.lit(',"summary":'),
        F.when(n % 5 == 0, '"short"').otherwise('"a first-line choice that has no side effects"'),
        F.lit("}"),
    )
    groups = F.when(n % 7 == 0, F.array(F.lit("Withdrawn"))).otherwise(F.array(F.lit("approved")))
    d = answers(spark, sf).select("conv_id", "turn", F.try_parse_json(body).alias("v"), groups.alias("groups"))
    return d.select(
        "conv_id", "turn", F.array_join(profile_issues(F.col("v")), "|").alias("issues"),
        F.array_join(en.profile_warnings(F.col("v"), F.col("groups")), "|").alias("warnings"),
    )


@plan(
    "enriched_records",
    "E7",
    f"""WITH {RECORDS_SQL} SELECT k, name, summary, '2025-01-01T00:00:' || lpad((k % 60)::VARCHAR, 2, '0') AS processed_at FROM enr""",
)
def enriched_records(spark, sf):
    return enriched_output(spark, sf).select(
        F.col("raw.k").alias("k"), F.col("raw.name").alias("name"), F.col("llm_enriched.summary").alias("summary"), "processed_at"
    )


def enriched_output(spark, sf):
    stamp = F.concat(F.lit("2025-01-01T00:00:"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"))
    cols = ["k", "drug_id", "name", "description", "indication", "mechanism_of_action", "toxicity", "groups"]
    return en.enriched_records(enriched(spark, sf), cols, "enriched", stamp)


@plan(
    "enrichment_prompts",
    "T-21",
    f"WITH {RECORDS_SQL} SELECT k, md5("
    + "'"
    + pm.ENRICHMENT_PROMPT.replace("'", "''")
    .replace("{{", "{").replace("}}", "}")
    .replace("{drug_id}", "' || coalesce(drug_id, 'unknown_id') || '")
    .replace("{name}", "' || coalesce(name, 'Unknown drug') || '")
    .replace("{cas_number}", "N/A").replace("{synonyms}", "").replace("{pharmacodynamics}", "N/A")
    .replace("{groups}", "' || gs || '")
    .replace("{indication}", "' || coalesce(indication, 'N/A') || '")
    .replace("{mechanism_of_action}", "' || coalesce(mechanism_of_action, 'N/A') || '")
    .replace("{description}", "' || coalesce(description, 'N/A') || '")
    + "') AS long_md5, md5('"
    + pm.SHORT_ENRICHMENT_PROMPT.replace("'", "''")
    .replace("{{", "{").replace("}}", "}")
    .replace("{drug_id}", "' || coalesce(drug_id, 'unknown_id') || '")
    .replace("{name}", "' || coalesce(name, 'Unknown drug') || '")
    .replace("{indication}", "' || coalesce(indication, 'N/A') || '")
    .replace("{mechanism_of_action}", "' || coalesce(mechanism_of_action, 'N/A') || '")
    .replace("{description}", "' || coalesce(description, 'N/A') || '")
    + "') AS short_md5 FROM src",
)
def enrichment_prompts(spark, sf):
    r = records(spark, sf)
    return r.select(
        "k",
        F.md5(pm.enrichment_prompt(r)).alias("long_md5"),
        F.md5(pm.enrichment_prompt(r, pm.SHORT_ENRICHMENT_PROMPT)).alias("short_md5"),
    )


@plan(
    "field_completeness",
    "V7",
    f"""WITH {RECORDS_SQL} SELECT 'mechanism_summary' AS field, round(avg(CASE WHEN mechanism_of_action <> '' THEN 1.0 ELSE 0.0 END), 6) AS before, 1.0::DOUBLE AS after FROM enr
    UNION ALL SELECT 'safety_notes', round(avg(CASE WHEN toxicity <> '' THEN 1.0 ELSE 0.0 END), 6), 1.0 FROM enr
    UNION ALL SELECT 'primary_indications', round(avg(CASE WHEN indication <> '' THEN 1.0 ELSE 0.0 END), 6), 1.0 FROM enr""",
)
def field_completeness(spark, sf):
    o = enriched_output(spark, sf)
    d = ev.completeness(
        o,
        {
            "mechanism_summary": (F.col("raw.mechanism_of_action") != "", F.col("llm_enriched.mechanism_summary") != ""),
            "safety_notes": (F.col("raw.toxicity") != "", F.col("llm_enriched.safety_notes") != ""),
            "primary_indications": (F.col("raw.indication") != "", F.size("llm_enriched.primary_indications") > 0),
        },
    )
    return d.withColumns({c: F.round(c, 6) for c in ("before", "after")})


@plan(
    "overlap_metrics",
    "V8",
    f"""WITH {RECORDS_SQL}, w AS (SELECT list_distinct({sql_words("concat_ws(' ', coalesce(description, ''), coalesce(indication, ''), coalesce(mechanism_of_action, ''), coalesce(toxicity, ''))")}) AS a,
      list_distinct({sql_words("concat_ws(' ', summary, how, 'Safety information not specified in the source record.')")}) AS b FROM enr),
    j AS (SELECT len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS sim FROM w)
    SELECT round(avg(CASE WHEN sim < 0.10 THEN 1.0 ELSE 0.0 END), 6) AS hdm, round(avg(sim), 6) AS fce_mean_jaccard FROM j""",
)
def overlap_metrics(spark, sf):
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.concat_ws(" ", *[blank(f"raw.{c}") for c in ("description", "indication", "mechanism_of_action", "toxicity")])
    out = F.concat_ws(" ", *[blank(f"llm_enriched.{c}") for c in ("summary", "mechanism_summary", "safety_notes")])
    d = ev.overlap_metrics(enriched_output(spark, sf), raw, out)
    return d.select(*[F.round(c, 6).alias(c) for c in ("hdm", "fce_mean_jaccard")])


@plan(
    "throughput",
    "V9",
    f"""WITH {RECORDS_SQL} SELECT round(count(*) / ((max(k % 60) - min(k % 60)) / 60.0::DOUBLE), 6) AS records_per_min FROM enr""",
)
def throughput(spark, sf):
    d = ev.throughput(enriched_output(spark, sf), "processed_at")
    return d.select(F.round("records_per_min", 6).alias("records_per_min"))


@plan(
    "chosen_enrichments",
    "E1 E7 D4",
    f"""WITH {ANSWERS_SQL}, p AS (SELECT conv_id, turn, question, CASE WHEN n % 17 = 0 AND n % 11 <> 0 THEN j2 ELSE content END AS c FROM
      (SELECT *, regexp_extract(content, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) AS j2 FROM answers)),
    v AS (SELECT *, CASE WHEN json_valid(c) THEN c::JSON END AS v FROM p),
    ok AS (SELECT *, coalesce(json_type(v) = 'OBJECT' AND json_type(v, '$.summary') = 'VARCHAR' AND json_type(v, '$.mechanism_summary') = 'VARCHAR'
      AND json_type(v, '$.safety_notes') = 'VARCHAR' AND json_type(v, '$.tags') = 'ARRAY', false) AS good FROM v)
    SELECT conv_id, turn, CASE WHEN good THEN v->>'$.summary' ELSE 'Turn is a drug in the DrugBank dataset.' || CASE WHEN question <> '' THEN ' Typical indications include: ' || substr(question, 1, 200) ELSE '' END END AS summary,
      CASE WHEN good THEN v->>'$.mechanism_summary' ELSE 'Mechanism not specified.' END AS mechanism_summary FROM ok""",
)
def chosen_enrichments(spark, sf):
    d = answers(spark, sf).select(
        "conv_id", "turn", "content", F.lit("Turn").alias("name"), F.col("question").alias("indication")
    )
    e = d.withColumn("e", en.chosen_enrichment(d, "content"))
    return e.select(
        "conv_id", "turn", F.col("e.summary").alias("summary"), F.col("e.mechanism_summary").alias("mechanism_summary")
    )


@plan(
    "enrichment_run_metrics",
    "V7 V8 V9 TR19",
    f"""WITH {RECORDS_SQL}, w AS (SELECT k, name, list_distinct({sql_words("concat_ws(' ', coalesce(description, ''), coalesce(indication, ''), coalesce(mechanism_of_action, ''), coalesce(toxicity, ''))")}) AS a,
      list_distinct({sql_words("concat_ws(' ', summary, how, 'Safety information not specified in the source record.')")}) AS b FROM enr),
    j AS (SELECT *, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS sim FROM w)
    SELECT count(*) AS num_records, 1.0::DOUBLE AS jsvs, 1.0::DOUBLE AS smr, round(avg(CASE WHEN sim < 0.10 THEN 1.0 ELSE 0.0 END), 6) AS hdm, round(avg(sim), 6) AS fce_mean_jaccard,
      round(avg(CASE WHEN k % 50 <> 0 THEN (k % 50)::DOUBLE END), 6) AS latency_ms_mean, round(count(*) / ((max(k % 60) - min(k % 60)) / 60.0::DOUBLE), 6) AS records_per_min FROM j""",
)
def enrichment_run_metrics(spark, sf):
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.concat_ws(" ", *[blank(f"raw.{c}") for c in ("description", "indication", "mechanism_of_action", "toxicity")])
    out = F.concat_ws(" ", *[blank(f"llm_enriched.{c}") for c in ("summary", "mechanism_summary", "safety_notes")])
    latency = F.when(F.col("raw.k") % 50 == 0, -1.0).otherwise((F.col("raw.k") % 50).cast("double"))
    valid = F.col("llm_enriched.summary").isNotNull() & F.col("llm_enriched.safety_notes").isNotNull()
    d = ev.enrichment_metrics(enriched_output(spark, sf), valid, raw, out, "processed_at", latency)
    return d.select("num_records", *[F.round(c, 6).alias(c) for c in d.columns if c != "num_records"])
