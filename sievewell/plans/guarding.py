"""Scope, answer-check and prompt queries (D, T-18..T-24)."""

from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.operators import guardrail as gr
from sievewell.operators import prompts as pm
from sievewell.plans.base import plan, table
from sievewell.plans.frames import ANSWERS_SQL, SCOPE_SQL, answers, asked, evidence_of, sql_strip, sql_tokenize
from sievewell.plans.texting import cosine_sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _find(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q('(?i)' + pattern)})"


def _scope_sql(pack: str) -> str:
    cases = [f"WHEN NOT {_find('query', P.DOMAIN_PACKS[pack])} THEN ['OUT_OF_SCOPE_QUERY', 'non-drug-related query', {_q(P.REFUSAL_OFF_TOPIC)}]"]
    cases += [f"WHEN {_find('query', p)} THEN [{_q(t)}, {_q(r)}, {_q(m)}]" for p, t, r, m in P.SCOPE_RULES]
    return f"""WITH {SCOPE_SQL}, c AS (SELECT doc_id, CASE {' '.join(cases)} END AS r FROM asked)
    SELECT doc_id, CASE WHEN r IS NULL THEN 0 ELSE 1 END AS blocked, r[1] AS rule_tag, r[2] AS reason, r[3] AS refusal_message FROM c"""


def _scoped(spark, sf, pack):
    d = gr.check_scope(asked(spark, sf), "query", pack)
    return d.select(
        "doc_id",
        F.col("scope.blocked").cast("int").alias("blocked"),
        F.col("scope.rule_tag").alias("rule_tag"),
        F.col("scope.reason").alias("reason"),
        F.col("scope.refusal_message").alias("refusal_message"),
    )


@plan("scope_check", "D1 D2", _scope_sql("intended"))
def scope_check(spark, sf):
    return _scoped(spark, sf, "intended")


@plan("scope_check_compatible", "D1 D2 TR4", _scope_sql("compatible"))
def scope_check_compatible(spark, sf):
    return _scoped(spark, sf, "compatible")


_FENCE = "(?s)```(?:json)?\\s*(.*?)\\s*```"
_TEXT_FIELDS = ["summary", "mechanism_summary", "safety_notes"]
# Parsed answers with schema issues, checked texts and evidence tokens.
PARSED_SQL = f"""{ANSWERS_SQL},
unfenced AS (SELECT *, CASE WHEN starts_with({sql_strip('content')}, '```') THEN regexp_extract({sql_strip('content')}, '{_FENCE}', 1) ELSE {sql_strip('content')} END AS c FROM answers),
parsed AS (SELECT *, CASE WHEN json_valid(c) THEN c::JSON END AS v FROM unfenced),
issued AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN json_type(v) <> 'OBJECT' THEN 'SCHEMA_ERROR: answer — not an object' ELSE concat_ws('|',
  CASE WHEN json_exists(v, '$.direct_answer') AND json_type(v, '$.direct_answer') NOT IN ('VARCHAR', 'NULL') THEN 'SCHEMA_ERROR: direct_answer — wrong type' END,
  CASE WHEN NOT json_exists(v, '$.summary') THEN 'SCHEMA_ERROR: summary — missing' WHEN json_type(v, '$.summary') <> 'VARCHAR' THEN 'SCHEMA_ERROR: summary — wrong type' END,
  CASE WHEN json_exists(v, '$.primary_indications') AND json_type(v, '$.primary_indications') <> 'ARRAY' THEN 'SCHEMA_ERROR: primary_indications — wrong type' END,
  CASE WHEN NOT json_exists(v, '$.mechanism_summary') THEN 'SCHEMA_ERROR: mechanism_summary — missing' WHEN json_type(v, '$.mechanism_summary') <> 'VARCHAR' THEN 'SCHEMA_ERROR: mechanism_summary — wrong type' END,
  CASE WHEN NOT json_exists(v, '$.safety_notes') THEN 'SCHEMA_ERROR: safety_notes — missing' WHEN json_type(v, '$.safety_notes') <> 'VARCHAR' THEN 'SCHEMA_ERROR: safety_notes — wrong type' END,
  CASE WHEN json_exists(v, '$.tags') AND json_type(v, '$.tags') <> 'ARRAY' THEN 'SCHEMA_ERROR: tags — wrong type' END) END AS issues FROM parsed)"""


@plan(
    "answer_schema_issues",
    "D3 D4 TR8 TR11",
    f"""WITH {PARSED_SQL} SELECT conv_id, turn, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS json_ok, coalesce(issues, '') AS issues FROM issued""",
)
def answer_schema_issues(spark, sf):
    d = answers(spark, sf).withColumn("v", gr.parse_answer(F.col("content")))
    return d.select(
        "conv_id",
        "turn",
        F.col("v").isNotNull().cast("int").alias("json_ok"),
        F.coalesce(F.array_join(F.when(F.col("v").isNotNull(), gr.schema_issues(F.col("v"))), "|"), F.lit("")).alias("issues"),
    )


DECIDED_SQL = f"""{PARSED_SQL},
typed AS (SELECT *, issues = '' AS schema_ok,
  coalesce(list_transform(json_extract(v, '$.primary_indications[*]'), lambda x: x->>'$'), []::VARCHAR[]) AS uses,
  concat_ws(' ', v->>'$.summary', array_to_string(coalesce(list_transform(json_extract(v, '$.primary_indications[*]'), lambda x: x->>'$'), []::VARCHAR[]), ' '),
     v->>'$.mechanism_summary', v->>'$.safety_notes') AS answer_text, array_to_string(ev, ' ') AS evidence_text FROM issued),
tok AS (SELECT *, CASE WHEN schema_ok THEN {sql_tokenize('answer_text')} ELSE [] END AS aw, {sql_tokenize('evidence_text')} AS ew FROM typed),
{cosine_sql('tok', 'conv_id, turn', 'aw', 'ew')},
kt AS (SELECT conv_id, turn, list_distinct(list_transform(list_sort(list_transform(list_filter(list_zip(aw, range(len(aw))),
    lambda z: NOT list_contains([{", ".join(_q(w) for w in P.KEY_TERM_STOP_WORDS)}], z[1])), lambda z: {{'l': -length(z[1]), 'i': z[2], 't': z[1]}}))[1:15], lambda z: z.t)) AS terms FROM tok),
scored AS (SELECT tok.*, CASE WHEN schema_ok AND len(ev) > 0 THEN coalesce(score, 0.0) ELSE 0.0 END AS g,
  len(terms) AS n_terms, len(list_intersect(terms, ew)) AS n_covered FROM tok LEFT JOIN cosine USING (conv_id, turn) LEFT JOIN kt USING (conv_id, turn)),
ratio AS (SELECT *, CASE WHEN schema_ok AND len(ev) > 0 AND n_terms > 0 THEN n_covered::DOUBLE / n_terms ELSE 0.0 END AS r FROM scored),
decided AS (SELECT *, CASE WHEN v IS NULL THEN 'JSON_INVALID' WHEN NOT schema_ok THEN 'SCHEMA_INVALID' WHEN len(ev) = 0 OR g < 0.45 THEN 'LOW_GROUNDING'
   WHEN r < 0.3 OR n_terms = 0 THEN 'LOW_COVERAGE' END AS rule_tag FROM ratio)"""


@plan(
    "answer_decisions",
    "D5 D6 D8 TR5 TR6",
    f"""WITH {DECIDED_SQL} SELECT conv_id, turn, CASE WHEN rule_tag IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS decision, rule_tag,
    round(CASE WHEN rule_tag IN ('JSON_INVALID', 'SCHEMA_INVALID') THEN 0.0 ELSE g END, 6) AS grounding_score,
    round(CASE WHEN rule_tag IN ('JSON_INVALID', 'SCHEMA_INVALID', 'LOW_GROUNDING') THEN 0.0 ELSE r END, 6) AS coverage_ratio FROM decided""",
)
def answer_decisions(spark, sf):
    return gr.decide(answers(spark, sf)).select(
        "conv_id", "turn", "decision", "rule_tag",
        F.round("grounding_score", 6).alias("grounding_score"), F.round("coverage_ratio", 6).alias("coverage_ratio"),
    )


@plan(
    "decision_messages",
    "D8",
    f"""WITH {DECIDED_SQL}, msg AS (SELECT *, CASE WHEN len(ev) = 0 THEN 'GROUNDING_SCORE=0.000 (no evidence)' ELSE format('GROUNDING_SCORE={{:.3f}} (threshold=0.45)', g) END AS gm,
      CASE WHEN len(ev) = 0 THEN 'COVERAGE_RATIO=0.000 (no evidence)' WHEN n_terms = 0 THEN 'COVERAGE_RATIO=0.000 (no key terms in output)'
        ELSE format('COVERAGE_RATIO={{:.3f}} ({{}}/{{}} terms covered)', r, n_covered, n_terms) END AS cm FROM decided)
    SELECT conv_id, turn, CASE WHEN rule_tag = 'JSON_INVALID' THEN 'JSON parse failed' WHEN rule_tag = 'SCHEMA_INVALID' THEN issues
      WHEN rule_tag = 'LOW_GROUNDING' THEN 'JSON_PARSE: OK|SCHEMA_CHECK: OK|' || gm ELSE 'JSON_PARSE: OK|SCHEMA_CHECK: OK|' || gm || '|' || cm END AS messages FROM msg""",
)
def decision_messages(spark, sf):
    return gr.decide(answers(spark, sf)).select("conv_id", "turn", F.array_join("messages", "|").alias("messages"))


@plan(
    "decisions_not_enforced",
    "D8",
    f"""WITH {DECIDED_SQL} SELECT conv_id, turn, CASE WHEN rule_tag IN ('JSON_INVALID', 'SCHEMA_INVALID') THEN 'BLOCK' ELSE 'ALLOW' END AS decision,
    round(CASE WHEN rule_tag IN ('JSON_INVALID', 'SCHEMA_INVALID') THEN 0.0 ELSE r END, 6) AS coverage_ratio FROM decided""",
)
def decisions_not_enforced(spark, sf):
    d = gr.decide(answers(spark, sf), check_grounding=False, check_coverage=False)
    return d.select("conv_id", "turn", "decision", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@plan(
    "evidence_sufficiency",
    "D7",
    f"""WITH {ANSWERS_SQL} SELECT conv_id, turn, CASE WHEN len(ev) >= 1 THEN 'RETRIEVAL_OK (' || len(ev) || ' snippets)'
      ELSE 'NO_RELEVANT_EVIDENCE (got ' || len(ev) || ', need 1)' END AS message FROM answers""",
)
def evidence_sufficiency(spark, sf):
    d = answers(spark, sf)
    return d.select("conv_id", "turn", gr.enough_evidence(F.col("evidence"))["message"].alias("message"))


_TRIVIAL = ", ".join(_q(t) for t in P.TRIVIAL_VALUES)


def _useful(c: str) -> str:
    s = sql_strip(f"coalesce({c}, '')")
    return f"CASE WHEN lower({s}) NOT IN ({_TRIVIAL}) THEN {s} END"


RENDERED_SQL = f"""{DECIDED_SQL},
parts AS (SELECT *, {_useful("v->>'$.direct_answer'")} AS d, {_useful("v->>'$.summary'")} AS s, {_useful("v->>'$.mechanism_summary'")} AS m,
  {_useful("v->>'$.safety_notes'")} AS sf, list_filter(list_transform(uses, lambda x: {_useful('x')}), lambda x: x IS NOT NULL) AS u FROM decided WHERE rule_tag IS NULL),
lines AS (SELECT *, CASE WHEN d IS NOT NULL THEN [d, CASE WHEN NOT contains(lower(d), lower(s)) THEN chr(10) || 'Context: ' || s END, chr(10) || 'Safety information: ' || sf]
  ELSE [s, CASE WHEN len(u) > 0 THEN chr(10) || 'Primary uses:' || chr(10) || array_to_string(list_transform(u, lambda x: '  • ' || x), chr(10)) END,
    chr(10) || 'How it works: ' || m, chr(10) || 'Safety information: ' || sf] END AS l FROM parts),
rendered AS (SELECT *, CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) > 0 THEN
  {sql_strip(f"array_to_string(list_filter(l, lambda x: x IS NOT NULL), chr(10)) || chr(10) || chr(10) || {_q(P.DISCLAIMER)}")} ELSE {_q(P.NO_CONTENT_TEXT)} END AS final_text FROM lines)"""


@plan(
    "rendered_answers",
    "T-22",
    f"WITH {RENDERED_SQL} SELECT conv_id, turn, final_text FROM rendered",
)
def rendered_answers(spark, sf):
    d = gr.decide(answers(spark, sf)).where("decision = 'ALLOW'")
    return d.select("conv_id", "turn", gr.render_answer(F.col("validated_output")).alias("final_text"))


@plan(
    "inference_records",
    "D11 D15 T-23",
    f"""WITH {RENDERED_SQL} SELECT x.conv_id, x.turn, coalesce(r.final_text, {_q(P.REFUSAL_DEFAULT)}) AS final_text_response,
    CASE WHEN x.rule_tag IS NULL THEN 'low' ELSE 'blocked' END AS hallucination_risk, x.rule_tag AS refusal_reason,
    CASE WHEN x.rule_tag IS NULL THEN x.v->>'$.summary' ELSE '' END AS summary, len(x.ev) AS evidence_count,
    array_to_string(list_transform(range(len(x.ev)), lambda i: x.conv_id || '_description_' || i || ':' || substr(x.ev[i + 1], 1, 300)), '|') AS citation_text
    FROM decided x LEFT JOIN rendered r USING (conv_id, turn)""",
)
def inference_records(spark, sf):
    d = gr.build_records(gr.decide(answers(spark, sf)), F.lit("2025-01-01T00:00:00"), "none")
    cited = F.transform("citations", lambda c: F.concat(c["evidence_id"], F.lit(":"), c["chunk_text"]))
    return d.select(
        "conv_id", "turn", "final_text_response", "hallucination_risk", "refusal_reason", "summary",
        F.col("evidence_count").cast("bigint").alias("evidence_count"), F.array_join(cited, "|").alias("citation_text"),
    )


@plan(
    "blocked_answers",
    "D15",
    f"""WITH {SCOPE_SQL} SELECT doc_id, 'Unable to provide verified information about this query.' AS summary, 'blocked,insufficient_evidence' AS tags
    FROM asked WHERE NOT {_find('query', P.DOMAIN_PACKS['intended'])}""",
)
def blocked_answers(spark, sf):
    d = gr.check_scope(asked(spark, sf), "query").where("scope.rule_tag = 'OUT_OF_SCOPE_QUERY'")
    d = d.withColumn("a", gr.blocked_answer())
    return d.select("doc_id", F.col("a.summary").alias("summary"), F.array_join("a.tags", ",").alias("tags"))


def passes(spark, sf):
    """First and second passes of every pair under every mode; the second sees the answer as evidence."""
    base = answers(spark, sf).withColumn(
        "model_mode", F.explode(F.array(*[F.lit(m[0]) for m in P.MODE_FLAGS]))
    )
    flags = gr.mode_table(spark).select("model_mode", "check_grounding", "check_coverage")
    base = base.join(F.broadcast(flags), "model_mode")  # three rows by definition
    run = lambda d: gr.decide(d, check_grounding=F.col("check_grounding"), check_coverage=F.col("check_coverage"))
    second = base.withColumn("evidence", evidence_of(F.array("answer"), F.col("conv_id")))
    return run(base), run(second)


_SECOND = DECIDED_SQL.replace("CASE WHEN n % 31 = 0 THEN [] WHEN n % 3 = 0 THEN [answer, 'unrelated words'] WHEN n % 3 = 1 THEN [question, answer] ELSE ['nothing of the kind'] END AS ev", "[answer] AS ev")
_MODES = "(VALUES ('baseline'), ('rag'), ('self_correcting')) AS modes(model_mode)"


@plan(
    "self_corrected_passes",
    "D9 D10",
    f"""WITH p1 AS (WITH {DECIDED_SQL} SELECT conv_id, turn, rule_tag FROM decided), p2 AS (WITH {_SECOND} SELECT conv_id, turn, rule_tag FROM decided)
    SELECT conv_id, turn, model_mode, CASE WHEN retry THEN t2 ELSE t1 END AS rule_tag, CASE WHEN retry THEN 2 ELSE 1 END AS guard_pass,
      CASE WHEN retry THEN t1 END AS correction_reason FROM (
      SELECT p1.conv_id, p1.turn, model_mode, p1.rule_tag AS t1, p2.rule_tag AS t2,
        model_mode = 'self_correcting' AND coalesce(p1.rule_tag IN ('LOW_GROUNDING', 'LOW_COVERAGE', 'RETRIEVAL_FAILURE'), false) AS retry
      FROM p1 JOIN p2 USING (conv_id, turn), {_MODES})""",
)
def self_corrected_passes(spark, sf):
    first, second = passes(spark, sf)
    d = gr.resolve_passes(first, second, ["conv_id", "turn", "model_mode"])
    return d.select("conv_id", "turn", "model_mode", "rule_tag", "guard_pass", "correction_reason")


@plan(
    "missing_answers",
    "D12",
    f"""WITH {DECIDED_SQL} SELECT conv_id, turn, rule_tag, CASE WHEN rule_tag IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS decision FROM decided
    UNION ALL SELECT conv_id, turn, 'RETRIEVAL_FAILURE', 'BLOCK' FROM conversations q WHERE role = 'user'
    AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn = q.turn + 1)""",
)
def missing_answers(spark, sf):
    answered = gr.decide(answers(spark, sf)).select(
        "conv_id", "turn", "decision", "rule_tag", "grounding_score", "coverage_ratio"
    )
    every = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn")
    d = gr.missing_answers(every, answered, ["conv_id", "turn"])
    return d.select("conv_id", "turn", "rule_tag", "decision")


# --- prompts --------------------------------------------------------------------------

_FOCUS_CASES = " ".join(f"WHEN {_find('query', p)} THEN {_q(f + '|' + l)}" for f, p, l in P.FIELD_FOCUS)


@plan("field_focus", "T-18", f"WITH {SCOPE_SQL} SELECT doc_id, CASE {_FOCUS_CASES} END AS focus FROM asked")
def field_focus(spark, sf):
    f = pm.field_focus(F.col("query"))
    return asked(spark, sf).select("doc_id", F.when(f.isNotNull(), F.concat_ws("|", f["field"], f["label"])).alias("focus"))


@plan(
    "expanded_queries",
    "T-19",
    f"WITH {SCOPE_SQL} SELECT doc_id, query || ' ' || {_q(P.RETRY_TAIL)} AS expanded FROM asked",
)
def expanded_queries(spark, sf):
    return asked(spark, sf).select("doc_id", pm.expand_query(F.col("query")).alias("expanded"))


def _focus_sql() -> str:
    head, rest = pm._FOCUS.split("{label}")
    mid, tail = rest.split("{field}")
    return f"CASE WHEN focus IS NULL THEN '' ELSE {_q(head)} || string_split(focus, '|')[2] || {_q(mid)} || string_split(focus, '|')[1] || {_q(tail)} END"


_OPENING = f"{pm._OPEN_EVIDENCE}\n\n{pm._HEAD}\n\n{P.ANSWER_SCHEMA_BLOCK}\n\n{pm._RULES_EVIDENCE}"


@plan(
    "generation_prompts",
    "T-20",
    f"""WITH {ANSWERS_SQL}, f AS (SELECT *, question AS query FROM answers), g AS (SELECT *, CASE {_FOCUS_CASES} END AS focus FROM f)
    SELECT conv_id, turn, {_q(_OPENING)} || {_focus_sql()} || CASE WHEN n % 2 = 0 THEN {_q(pm._STRICT)} ELSE '' END || chr(10) || 'Query: ' || query || chr(10) || chr(10) || 'Evidence:' || chr(10)
      || CASE WHEN len(ev) = 0 THEN '(no evidence retrieved)' ELSE array_to_string(list_transform(ev, lambda e: 'Drug: turn' || chr(10) || 'Field: description' || chr(10) || 'Content: ' || e), chr(10) || chr(10)) END
      || {_q(pm._CLOSE)} AS prompt FROM g""",
)
def generation_prompts(spark, sf):
    d = answers(spark, sf)
    q = F.col("question")
    prompt = pm.build_prompt_col(q, F.col("evidence"), pm.field_focus(q), F.col("n") % 2 == 0)
    return d.select("conv_id", "turn", prompt.alias("prompt"))


_OPENING_BASE = f"{pm._OPEN_BASE}\n\n{pm._HEAD}\n\n{P.ANSWER_SCHEMA_BLOCK}\n\n{pm._RULES_BASE}"


@plan(
    "baseline_prompts",
    "T-20",
    f"""WITH {SCOPE_SQL}, g AS (SELECT *, CASE {_FOCUS_CASES} END AS focus FROM asked)
    SELECT doc_id, {_q(_OPENING_BASE)} || {_focus_sql()} || chr(10) || 'Query: ' || query || {_q(pm._CLOSE)} AS prompt FROM g""",
)
def baseline_prompts(spark, sf):
    q = F.col("query")
    return asked(spark, sf).select("doc_id", pm.build_prompt_col(q, None, pm.field_focus(q)).alias("prompt"))


def _u(what: str) -> str:
    return f"(('0x' || substr(md5('42|{what}|' || prompt_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"


@plan(
    "generated_prompts",
    "T-24 P6",
    f"""WITH r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || p_partkey), 1, 15))::BIGINT, p_partkey) - 1 AS rn FROM part),
    t AS (SELECT [{", ".join(_q(a + '|' + b) for a, b in P.PROMPT_TEMPLATES)}] AS t),
    p AS (SELECT range AS prompt_id FROM range(500)),
    k AS (SELECT prompt_id, floor({_u('record')} * (SELECT count(*) FROM part))::BIGINT AS rn, t[floor({_u('template')} * 10)::BIGINT + 1] AS tt FROM p, t)
    SELECT prompt_id, p_partkey::VARCHAR AS drug_id, p_name AS drug_name, replace(string_split(tt, '|')[2], '{{name}}', p_name) AS query,
      string_split(tt, '|')[1] AS query_type, p_name AS expected_drug FROM k JOIN r USING (rn)""",
)
def generated_prompts(spark, sf):
    return pm.generate_prompts(table(spark, sf, "part"), "p_partkey", "p_name", 500)


@plan(
    "recomputed_decisions",
    "V5 D8",
    f"""WITH {DECIDED_SQL} SELECT conv_id, turn, CASE WHEN n % 4 = 0 THEN 'ALLOW' WHEN rule_tag IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS decision, rule_tag,
    round(CASE WHEN n % 4 = 0 THEN 0.5 WHEN rule_tag IN ('JSON_INVALID', 'SCHEMA_INVALID') THEN 0.0 ELSE g END, 6) AS grounding_score FROM decided""",
)
def recomputed_decisions(spark, sf):
    from sievewell.operators.evaluate import fill_decisions

    recorded = answers(spark, sf).withColumns(
        {
            "decision": F.when(F.col("n") % 4 == 0, "ALLOW"),
            "rule_tag": F.lit(None).cast("string"),
            "grounding_score": F.when(F.col("n") % 4 == 0, 0.5),
            "coverage_ratio": F.lit(None).cast("double"),
        }
    )
    d = fill_decisions(recorded)
    return d.select("conv_id", "turn", "decision", "rule_tag", F.round("grounding_score", 6).alias("grounding_score"))


# --- questions end to end -------------------------------------------------------------------

QUESTIONS_SQL = """SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Which drug interactions are known of ' || text ELSE 'What is the mechanism of the medicine ' || text END AS query FROM benchmark
  UNION ALL SELECT 1000 + row_number() OVER (ORDER BY source), 'What are the side effects of ' || source || ' and what is it used for?' FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT 2000 + row_number() OVER (ORDER BY source), 'What dose of ' || source || ' should I take?' FROM (SELECT DISTINCT source FROM documents)"""


def questions(spark, sf):
    """Passages in and out of scope, and questions about document sources, some of which no rule lets pass."""
    from pyspark.sql import Window as W

    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked_of = F.when(F.col("query_id") % 3 == 0, F.col("text")).when(
        F.col("query_id") % 3 == 1, F.concat(F.lit("Which drug interactions are known of "), "text")
    )
    asked_of = asked_of.otherwise(F.concat(F.lit("What is the mechanism of the medicine "), "text"))
    sources = table(spark, sf, "documents").select("source").distinct()
    # One row per source name: a dimension, so its numbering window is small.
    n = F.row_number().over(W.orderBy("source")).cast("bigint")
    effects = sources.select((1000 + n).alias("query_id"), F.concat(F.lit("What are the side effects of "), "source", F.lit(" and what is it used for?")).alias("query"))
    doses = sources.select((2000 + n).alias("query_id"), F.concat(F.lit("What dose of "), "source", F.lit(" should I take?")).alias("query"))
    return passages.select("query_id", asked_of.alias("query")).unionByName(effects).unionByName(doses)


def quoted(made):
    """Stands for a model: some answers quote the first evidence, some only when they are told to be strict, some are no JSON."""
    top = F.substring(F.coalesce(F.try_element_at("evidence", F.lit(1))["chunk_text"], F.lit("")), 1, 240)
    says = lambda text: F.to_json(F.struct(text.alias("summary"), F.lit("").alias("mechanism_summary"), F.lit("").alias("safety_notes")))
    loose = says(F.lit("nothing of the kind is known"))
    n = F.col("query_id") % 4
    return made.withColumn("content", F.when(n == 1, F.lit("no json")).when((n == 0) | ((n == 2) & F.col("strict")), says(top)).otherwise(loose))


def _two_passes_sql() -> str:
    from sievewell.plans.retrieving import BM25_SQL, _top
    from sievewell.plans.frames import QUERIES_SQL

    cases = [f"WHEN NOT {_find('query', P.DOMAIN_PACKS['intended'])} THEN 'OUT_OF_SCOPE_QUERY'"]
    cases += [f"WHEN {_find('query', p)} THEN {_q(t)}" for p, t, _, _ in P.SCOPE_RULES]
    scoped = f"questions AS ({QUESTIONS_SQL}), scoped AS (SELECT *, CASE {' '.join(cases)} END AS scope_tag FROM questions)"
    # both forms of every question are searched; which second passes count is decided at the end
    both = f"SELECT query_id * 2 AS query_id, query FROM scoped WHERE scope_tag IS NULL UNION ALL SELECT query_id * 2 + 1, query || ' ' || {_q(P.RETRY_TAIL)} FROM scoped WHERE scope_tag IS NULL"
    says = "json_object('summary', {}, 'mechanism_summary', '', 'safety_notes', '')::VARCHAR"
    made = f"""found AS (SELECT t.query_id, list(ck.chunk_text ORDER BY rank) AS ev FROM ({_top('boosted', 5)}) t JOIN ck USING (key) GROUP BY 1),
asked AS (SELECT s.query_id AS conv_id, turn, coalesce(ev, []) AS ev FROM scoped s, (VALUES (0), (1)) p(turn) LEFT JOIN found f ON f.query_id = s.query_id * 2 + turn WHERE scope_tag IS NULL),
answers AS (SELECT *, CASE WHEN conv_id % 4 = 1 THEN 'no json' WHEN conv_id % 4 = 0 OR (conv_id % 4 = 2 AND turn = 1) THEN {says.format("coalesce(substr(ev[1], 1, 240), '')")} ELSE {says.format("'nothing of the kind is known'")} END AS content FROM asked)"""
    searched = BM25_SQL.replace(QUERIES_SQL, both)
    return f"""WITH {scoped}, {searched}, {DECIDED_SQL.replace(ANSWERS_SQL, made)},
passes AS (SELECT a.conv_id AS query_id, a.rule_tag AS t1, b.rule_tag AS t2, a.g AS g1, b.g AS g2, len(a.ev) AS n1, len(b.ev) AS n2, a.v AS v1, b.v AS v2,
  coalesce(a.rule_tag IN ('LOW_GROUNDING', 'LOW_COVERAGE', 'RETRIEVAL_FAILURE'), false) AS again
  FROM decided a JOIN decided b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
kept AS (SELECT query_id, CASE WHEN again THEN t2 ELSE t1 END AS rule_tag, CASE WHEN again THEN 2 ELSE 1 END AS guard_pass, CASE WHEN again THEN t1 END AS correction_reason,
  CASE WHEN again THEN n2 ELSE n1 END AS evidence_count, CASE WHEN again THEN v2 ELSE v1 END AS v, CASE WHEN again THEN g2 ELSE g1 END AS g, again FROM passes)
SELECT s.query_id, CASE WHEN s.scope_tag IS NOT NULL OR k.rule_tag IS NOT NULL THEN 'BLOCK' ELSE 'ALLOW' END AS decision, coalesce(s.scope_tag, k.rule_tag) AS rule_tag,
  coalesce(k.guard_pass, 1) AS guard_pass, k.correction_reason, coalesce(k.evidence_count, 0) AS evidence_count,
  CASE WHEN s.scope_tag IS NOT NULL THEN 'high' WHEN k.rule_tag IS NULL THEN 'low' ELSE 'blocked' END AS hallucination_risk,
  CASE WHEN s.scope_tag IS NULL THEN s.query || CASE WHEN k.again THEN ' ' || {_q(P.RETRY_TAIL)} ELSE '' END END AS retrieval_query_used,
  CASE WHEN s.scope_tag IS NULL AND k.rule_tag IS NULL THEN k.v->>'$.summary' ELSE '' END AS summary,
  round(CASE WHEN s.scope_tag IS NOT NULL OR k.rule_tag IN ('JSON_INVALID', 'SCHEMA_INVALID') THEN 0.0 ELSE k.g END, 6) AS confidence_score
FROM scoped s LEFT JOIN kept k USING (query_id)"""


@plan("question_records", "D8 D9 D10 D11 D12 R6 T-19", _two_passes_sql())
def question_records(spark, sf):
    from sievewell.operators.questions import question_records as records
    from sievewell.plans.retrieving import evidence_of_queries

    d = records(questions(spark, sf), lambda q: evidence_of_queries(spark, sf, q), quoted, F.lit("2025-01-01T00:00:00"), "none")
    return d.select(
        "query_id", "decision", "rule_tag", "guard_pass", "correction_reason", F.col("evidence_count").cast("bigint").alias("evidence_count"), "hallucination_risk",
        "retrieval_query_used", "summary", F.round("confidence_score", 6).alias("confidence_score"),
    )
