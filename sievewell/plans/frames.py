"""Frames derived from the driver tables, in Spark and as SQL.

The tables are not medicine records, so each frame maps them onto the shape an
operator expects. Some rows get a fault injected by a key expression; every row
of the source table stays in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.plans.base import table, text_table

# One expression list in SQL serves both engines: the dialects agree on it.
SILVER_COLUMNS = """
  o_orderkey AS k,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       WHEN o_orderkey % 101 = 0 THEN concat('DB', lpad(cast(o_orderkey + 1 AS string), 12, '0'))
       WHEN o_orderkey % 103 = 0 THEN concat('XX', cast(o_orderkey AS string))
       ELSE concat('DB', lpad(cast(o_orderkey AS string), 12, '0')) END AS drug_id,
  CASE WHEN o_orderkey % 107 = 0 THEN '  ' WHEN o_orderkey % 113 = 0 THEN NULL ELSE c_name END AS drug_name,
  CASE WHEN o_orderkey % 109 = 0 THEN -o_totalprice
       WHEN o_orderkey % 127 = 0 THEN NULL
       WHEN o_orderkey % 131 = 0 THEN o_totalprice * 8 ELSE o_totalprice END AS avg_mass,
  concat('Order of ', c_name, ' with status ', o_orderstatus, '. Priority ', o_orderpriority, '.') AS description,
  CASE WHEN o_orderkey % 137 = 0 THEN 'short' WHEN o_orderkey % 139 = 0 THEN NULL
       ELSE concat('priority ', o_orderpriority) END AS indication,
  CASE WHEN o_orderkey % 149 = 0 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN concat('partial Agonist in ', c_mktsegment)
       WHEN o_orderkey % 3 = 1 THEN concat('selective inhibitor in ', c_mktsegment)
       ELSE concat('mixed antagonist in ', c_mktsegment) END AS mechanism,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('toxicity class ', o_orderstatus) END AS toxicity,
  CASE WHEN o_orderkey % 151 = 0 THEN NULL WHEN o_orderkey % 157 = 0 THEN ' '
       ELSE cast(cast(o_orderdate AS date) AS string) END AS ingest_dt
"""

SILVER_SQL = f"SELECT {SILVER_COLUMNS} FROM orders JOIN customer ON o_custkey = c_custkey"


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standardised table with the faults the quality rules look for."""
    return spark.sql(
        f"SELECT {SILVER_COLUMNS} FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey",
        orders=text_table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
    )


MESSAGES_SQL = """
SELECT event_id, ts,
  CASE WHEN event_id % 53 = 0 THEN '{"id": ' || event_id || ', "text": "cut'
       WHEN event_id % 59 = 0 THEN '{"id": ' || event_id || ', "source": "' || event_type || '"}'
       WHEN event_id % 61 = 0 THEN '{"id": ' || event_id || ', "text": "k' || event_id || '"}'
       WHEN event_id % 67 = 0 THEN '{"id": ' || event_id || ', "source": null, "text": "k' || event_id || '"}'
       ELSE '{"id": ' || event_id || ', "source": "' || event_type || '", "text": "' || event_type || ' by user ' || user_id || '"}'
  END AS value
FROM events
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages: some cut off, some without text, some without source."""
    id_ = F.col("event_id").cast("string")
    kind = F.col("event_type")
    m = F.col("event_id")
    value = (
        F.when(m % 53 == 0, F.concat(F.lit('{"id": '), id_, F.lit(', "text": "cut')))
        .when(m % 59 == 0, F.concat(F.lit('{"id": '), id_, F.lit(', "source": "'), kind, F.lit('"}')))
        .when(m % 61 == 0, F.concat(F.lit('{"id": '), id_, F.lit(', "text": "k'), id_, F.lit('"}')))
        .when(m % 67 == 0, F.concat(F.lit('{"id": '), id_, F.lit(', "source": null, "text": "k'), id_, F.lit('"}')))
        .otherwise(
            F.concat(
                F.lit('{"id": '), id_, F.lit(', "source": "'), kind, F.lit('", "text": "'), kind,
                F.lit(" by user "), F.col("user_id").cast("string"), F.lit('"}'),
            )
        )
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", value.alias("value"))


# SQL twins of the text functions, for the DuckDB side.
def sql_clean_markup(c: str) -> str:
    from sievewell.functions.patterns import MARKUP

    for pattern, replacement in MARKUP:
        replacement = replacement.replace("$1", "\\1")
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return c


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_tokenize(c: str) -> str:
    return sql_words(sql_clean_markup(c))


SPACE_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sql_strip(c: str) -> str:
    return f"trim({c}, {SPACE_SQL})"


QUERIES_SQL = """
SELECT item_id AS query_id, text AS query FROM benchmark
UNION ALL
SELECT 1000000000 + row_number() OVER (ORDER BY source) AS query_id,
       'What are the side effects of ' || source || ' and what is it used for?' AS query
FROM (SELECT DISTINCT source FROM documents)
"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, and one templated question per document source."""
    from pyspark.sql import Window as W

    sources = table(spark, sf_dir, "documents").select("source").distinct()
    # One row per source name: a dimension, so its numbering window is small.
    numbered = sources.select(
        (F.lit(1000000000) + F.row_number().over(W.orderBy("source"))).cast("bigint").alias("query_id"),
        F.concat(
            F.lit("What are the side effects of "), "source", F.lit(" and what is it used for?")
        ).alias("query"),
    )
    passages = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("bigint").alias("query_id"), F.col("text").alias("query")
    )
    return passages.unionByName(numbered)


# --- answers -----------------------------------------------------------------------

# Question and answer turns with an answer object made from them. Every answer is
# kept; the turn number decides which defect it gets.
PAIRS_SQL = """pairs AS (SELECT q.conv_id, q.turn, q.conv_id * 7 + q.turn AS n, q.text AS question, a.text AS answer
  FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""

ANSWERS_SQL = f"""{PAIRS_SQL},
answers AS (SELECT conv_id, turn, n, question, answer,
  CASE WHEN n % 11 = 0 THEN '{{' || j WHEN n % 17 = 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN n % 29 = 0 THEN '[' || j || ']' ELSE j END AS content,
  CASE WHEN n % 31 = 0 THEN [] WHEN n % 3 = 0 THEN [answer, 'unrelated words'] WHEN n % 3 = 1 THEN [question, answer] ELSE ['nothing of the kind'] END AS ev
  FROM (SELECT *, CASE
    WHEN n % 13 = 0 THEN json_object('summary', answer, 'primary_indications', ['pain relief', 'fever'], 'mechanism_summary', 'Not specified', 'tags', ['a'])::VARCHAR
    WHEN n % 19 = 0 THEN json_object('summary', answer, 'mechanism_summary', 'Not specified', 'safety_notes', question, 'tags', NULL)::VARCHAR
    WHEN n % 23 = 0 THEN json_object('summary', 5, 'mechanism_summary', 'Not specified', 'safety_notes', question, 'tags', ['a'])::VARCHAR
    WHEN n % 37 = 0 THEN json_object('direct_answer', 'Twice a day.', 'summary', answer, 'primary_indications', ['pain relief'], 'mechanism_summary', 'n/a', 'safety_notes', 'None', 'tags', ['a'])::VARCHAR
    ELSE json_object('summary', answer, 'primary_indications', ['pain relief', ' unknown ', 'fever'], 'mechanism_summary', 'Not specified', 'safety_notes', 'Ask first.', 'tags', ['a', 'b', 'c'])::VARCHAR END AS j FROM pairs))"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn that follows it."""
    c = text_table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("n"), "question", "answer"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer objects as JSON text with evidence arrays; see ``ANSWERS_SQL``."""
    n = F.col("n")
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    part = lambda **kw: F.to_json(F.struct(*[c.alias(k) for k, c in kw.items()]), {"ignoreNullFields": "false"})
    unsaid, answer, question = F.lit("Not specified"), F.col("answer"), F.col("question")
    j = (
        F.when(n % 13 == 0, part(summary=answer, primary_indications=strings("pain relief", "fever"),
                                 mechanism_summary=unsaid, tags=strings("a")))
        .when(n % 19 == 0, part(summary=answer, mechanism_summary=unsaid, safety_notes=question,
                                tags=F.lit(None).cast("array<string>")))
        .when(n % 23 == 0, part(summary=F.lit(5), mechanism_summary=unsaid, safety_notes=question, tags=strings("a")))
        .when(n % 37 == 0, part(direct_answer=F.lit("Twice a day."), summary=answer,
                                primary_indications=strings("pain relief"), mechanism_summary=F.lit("n/a"),
                                safety_notes=F.lit("None"), tags=strings("a")))
        .otherwise(part(summary=answer, primary_indications=strings("pain relief", " unknown ", "fever"),
                        mechanism_summary=unsaid, safety_notes=F.lit("Ask first."), tags=strings("a", "b", "c")))
    )
    content = (
        F.when(n % 11 == 0, F.concat(F.lit("{"), j))
        .when(n % 17 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
        .when(n % 29 == 0, F.concat(F.lit("["), j, F.lit("]")))
        .otherwise(j)
    )
    texts = (
        F.when(n % 31 == 0, F.array().cast("array<string>"))
        .when(n % 3 == 0, F.array(answer, F.lit("unrelated words")))
        .when(n % 3 == 1, F.array(question, answer))
        .otherwise(strings("nothing of the kind"))
    )
    return turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", "n", "question", "answer", content.alias("content"),
        evidence_of(texts, F.col("conv_id")).alias("evidence"),
    )


def evidence_of(texts, owner):
    """Evidence structs around an array of texts."""
    return F.transform(
        texts,
        lambda t, i: F.struct(
            owner.cast("string").alias("drug_id"),
            F.lit("turn").alias("drug_name"),
            F.lit("description").alias("field_name"),
            i.alias("chunk_idx"),
            t.alias("chunk_text"),
            (F.lit(1.0) / (i + 1)).alias("bm25_score"),
        ),
    )


EVAL_SQL = """ev AS (SELECT d.doc_id, quality = 1 AS should_allow, (length(text) % 101) / 100.0::DOUBLE AS grounding_score,
  (length(text) % 53) / 53.0::DOUBLE AS coverage_ratio, 20 + n_chars / 100.0::DOUBLE AS latency_ms,
  CASE d.doc_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'rag' ELSE 'self_correcting' END AS model_mode,
  CASE WHEN d.doc_id % 11 = 0 THEN '{' ELSE '' END || CASE WHEN d.doc_id % 13 = 0 THEN json_object('summary', source)::VARCHAR
    ELSE json_object('summary', source, 'mechanism_summary', lang, 'safety_notes', '')::VARCHAR END AS content
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
evals AS (SELECT *, CASE WHEN grounding_score < 0.45 THEN 'LOW_GROUNDING' WHEN coverage_ratio < 0.3 THEN 'LOW_COVERAGE' END AS rule_tag,
  CASE WHEN grounding_score >= 0.45 AND coverage_ratio >= 0.3 THEN 'ALLOW' ELSE 'BLOCK' END AS decision FROM ev)"""


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference records: labelled documents with scores from their text length."""
    d = text_table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    g = (F.length("text") % 101) / 100.0
    c = (F.length("text") % 53) / 53.0
    body = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    content = F.concat(
        F.when(F.col("doc_id") % 11 == 0, "{").otherwise(""),
        F.when(F.col("doc_id") % 13 == 0, body(summary=F.col("source"))).otherwise(
            body(summary=F.col("source"), mechanism_summary=F.col("lang"), safety_notes=F.lit(""))
        ),
    )
    mode = (
        F.when(F.col("doc_id") % 3 == 0, "baseline").when(F.col("doc_id") % 3 == 1, "rag").otherwise("self_correcting")
    )
    d = d.select(
        "doc_id",
        (F.col("quality") == 1).alias("should_allow"),
        g.alias("grounding_score"),
        c.alias("coverage_ratio"),
        (20 + F.col("n_chars") / 100.0).alias("latency_ms"),
        mode.alias("model_mode"),
        content.alias("content"),
    )
    low_g, low_c = F.col("grounding_score") < 0.45, F.col("coverage_ratio") < 0.3
    return d.withColumns(
        {
            "rule_tag": F.when(low_g, "LOW_GROUNDING").when(low_c, "LOW_COVERAGE"),
            "decision": F.when(~low_g & ~low_c, "ALLOW").otherwise("BLOCK"),
        }
    )


SCOPE_PHRASES = [
    "What is the mechanism of", "Tell me about the drug", "How much of the dose should I take of",
    "Do I have an infection, is this drug", "Please write me a prescription for the drug",
    "Can I take aspirin with my", "What is a lethal dose of", "What is the weather in", "What are the side effects of",
    "Should I stop taking the medicine", "Which food interactions has", "What is the half-life of the tablet",
    "How does it work in the body:", "What is ibuprofen used for, says",
]

SCOPE_SQL = (
    "asked AS (SELECT doc_id, (["
    + ", ".join(f"'{p}'" for p in SCOPE_PHRASES)
    + f"])[doc_id % {len(SCOPE_PHRASES)} + 1] || ' ' || source || '?' AS query FROM documents)"
)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per document: a phrase chosen by the id, about the document's source."""
    phrases = F.array(*[F.lit(p) for p in SCOPE_PHRASES])
    chosen = F.get(phrases, (F.col("doc_id") % len(SCOPE_PHRASES)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(chosen, F.lit(" "), "source", F.lit("?")).alias("query")
    )
