"""Scope rules, answer checks and the ALLOW / BLOCK decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.functions import text as tx

ANSWER_TYPE = (
    "struct<direct_answer:string,summary:string,primary_indications:array<string>,"
    "mechanism_summary:string,safety_notes:string,tags:array<string>>"
)

# --- scope ------------------------------------------------------------------------


def is_on_topic(query: Column, pack: str = "intended") -> Column:
    return tx.regex_find(query, P.DOMAIN_PACKS[pack])


def scope_result(query: Column, pack: str = "intended") -> Column:
    """struct(blocked, rule_tag, reason, refusal_message); the first rule that matches wins."""

    def result(blocked: bool, tag, reason, refusal) -> Column:
        text = lambda v: F.lit(v).cast("string")
        return F.struct(
            F.lit(blocked).alias("blocked"),
            text(tag).alias("rule_tag"),
            text(reason).alias("reason"),
            text(refusal).alias("refusal_message"),
        )

    q = F.coalesce(query, F.lit(""))
    rules = [(~is_on_topic(q, pack), result(True, "OUT_OF_SCOPE_QUERY", "non-drug-related query", P.REFUSAL_OFF_TOPIC))]
    rules += [(tx.regex_find(q, pattern), result(True, *rest)) for pattern, *rest in P.SCOPE_RULES]
    return tx.first_match(rules, result(False, None, None, None))


def check_scope(df: DataFrame, query: str, pack: str = "intended") -> DataFrame:
    return df.withColumn("scope", scope_result(F.col(query), pack))


# --- answer parsing and schema ------------------------------------------------------


def unfence(content: Column) -> Column:
    """The inside of a Markdown code fence when the text starts with one."""
    c = tx.strip(content)
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.when(F.startswith(c, F.lit("```")) & c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)


def parse_answer(content: Column) -> Column:
    """The answer as a variant value, or null when it is no JSON."""
    return F.try_parse_json(unfence(content))


def kind_of(value: Column, path: str) -> Column:
    """Type name of the value at a path; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _list_of_strings(value: Column, path: str) -> Column:
    kind = kind_of(value, path)
    return kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(
        F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>")),
        lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "STRING",
    )


def schema_issues(value: Column) -> Column:
    """Names of what is wrong with a parsed answer, an empty array when nothing is.

    Types are strict: a number is no string and a null list is no list. A
    top-level value that is no object is one issue instead of an error.
    """
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    found = []
    for field, kind, required in P.ANSWER_SCHEMA:
        path = f"$.{field}"
        have = kind_of(value, path)
        if kind == "string?":
            wrong = have.isNotNull() & ~have.isin("STRING", "VOID")
        elif kind == "string":
            wrong = have.isNotNull() & (have != "STRING")
        else:
            wrong = have.isNotNull() & ~_list_of_strings(value, path)
        if required:
            found.append(F.when(have.isNull(), F.lit(f"SCHEMA_ERROR: {field} — missing")))
        found.append(F.when(wrong, F.lit(f"SCHEMA_ERROR: {field} — wrong type")))
    fields = F.array_compact(F.array(*found))
    return F.when(is_object, fields).otherwise(F.array(F.lit("SCHEMA_ERROR: answer — not an object")))


def typed_answer(value: Column) -> Column:
    """The parsed answer as a struct; read it only where the schema holds."""
    get = lambda f, t: F.try_variant_get(value, f"$.{f}", t)
    empty = F.array().cast("array<string>")
    return F.struct(
        get("direct_answer", "string").alias("direct_answer"),
        get("summary", "string").alias("summary"),
        F.coalesce(get("primary_indications", "array<string>"), empty).alias("primary_indications"),
        get("mechanism_summary", "string").alias("mechanism_summary"),
        get("safety_notes", "string").alias("safety_notes"),
        F.coalesce(get("tags", "array<string>"), empty).alias("tags"),
    )


def profile_issues(value: Column) -> Column:
    """Issues of the seven-field profile answer: missing, null, blank, list types, short summary."""
    found = []
    for field in P.PROFILE_FIELDS:
        have = kind_of(value, f"$.{field}")
        text = F.try_variant_get(value, f"$.{field}", "string")
        found.append(
            F.when(have.isNull(), F.lit(f"Missing field: {field}"))
            .when(have == "VOID", F.lit(f"Null value for field: {field}"))
            .when((have == "STRING") & (F.length(tx.strip(text)) == 0), F.lit(f"Empty string for field: {field}"))
        )
    for field in ("side_effects", "contraindications"):
        have = kind_of(value, f"$.{field}")
        found.append(
            F.when(have.isNotNull() & ~F.startswith(have, F.lit("ARRAY")), F.lit(f"{field} must be a list of strings"))
        )
    summary = F.try_variant_get(value, "$.summary", "string")
    short = (kind_of(value, "$.summary") == "STRING") & (F.length(summary) < 20)
    found.append(F.when(short, F.lit("summary is suspiciously short (<20 chars)")))
    return F.array_compact(F.array(*found))


# --- grounding and coverage -----------------------------------------------------------


def answer_text(answer: Column) -> Column:
    """The checked fields in order; the direct answer and the tags are not checked."""
    return F.concat_ws(
        " ",
        F.coalesce(answer["summary"], F.lit("")),
        F.array_join(answer["primary_indications"], " "),
        F.coalesce(answer["mechanism_summary"], F.lit("")),
        F.coalesce(answer["safety_notes"], F.lit("")),
    )


def evidence_text(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.coalesce(e["chunk_text"], F.lit(""))), " ")


def grounding_score(answer_tokens: Column, evidence_tokens: Column) -> Column:
    return tx.tfidf_cosine(answer_tokens, evidence_tokens)


def coverage_counts(answer_tokens: Column, evidence_tokens: Column) -> Column:
    """struct(covered, terms): key terms of the answer, and how many the evidence has."""
    return tx.bind(
        tx.key_terms(answer_tokens),
        lambda terms: F.struct(
            F.size(F.array_intersect(terms, evidence_tokens)).alias("covered"), F.size(terms).alias("terms")
        ),
    )


def enough_evidence(evidence: Column, minimum: int = 1) -> Column:
    """struct(ok, message)."""
    n = F.coalesce(F.size(evidence), F.lit(0))
    return F.struct(
        (n >= minimum).alias("ok"),
        F.when(n >= minimum, F.format_string("RETRIEVAL_OK (%d snippets)", n))
        .otherwise(F.format_string(f"NO_RELEVANT_EVIDENCE (got %d, need {minimum})", n))
        .alias("message"),
    )


def decide(
    df: DataFrame,
    content: str = "content",
    evidence: str = "evidence",
    grounding: float = P.GROUNDING_THRESHOLD,
    coverage: float = P.COVERAGE_THRESHOLD,
    check_grounding: Column | bool = True,
    check_coverage: Column | bool = True,
) -> DataFrame:
    """Add the decision columns: JSON, schema, grounding and coverage in that order.

    Adds decision, rule_tag, grounding_score, coverage_ratio, messages,
    validated_output and safe_refusal_message. Scores after the check that
    blocked are zero. All steps are row-wise projections.
    """
    flag = lambda v: F.lit(v) if isinstance(v, bool) else v
    ev = F.coalesce(F.col(evidence), F.array().cast(df.schema[evidence].dataType))
    limits = (grounding, coverage, flag(check_grounding), flag(check_coverage))
    # One expression with bound intermediate values: a later filter on the
    # decision is pushed below it as a whole and does not multiply the parsing.
    result = tx.bind(
        parse_answer(F.col(content)),
        lambda v: tx.bind(
            schema_issues(v),
            lambda issues: tx.bind(
                F.when(F.size(issues) == 0, typed_answer(v)),
                lambda answer: tx.bind(
                    _scores(answer, ev),
                    lambda s: tx.bind(
                        _rule_tag(v, issues, s, *limits), lambda tag: _outcome(tag, issues, answer, s, *limits)
                    ),
                ),
            ),
        ),
    )
    d = df.withColumn("_result", result)
    return d.select(*[c for c in df.columns if c not in _DECISION], *[F.col(f"_result.{c}").alias(c) for c in _DECISION])


_DECISION = [
    "decision", "rule_tag", "grounding_score", "coverage_ratio", "messages",
    "validated_output", "safe_refusal_message",
]


def _scores(answer: Column, evidence: Column) -> Column:
    """struct(any, g, covered, terms, r): is there evidence, grounding, coverage counts and ratio."""
    some = F.size(evidence) > 0

    def counted(a: Column, e: Column) -> Column:
        return tx.bind(
            coverage_counts(a, e),
            lambda c: F.struct(
                F.lit(True).alias("any"),
                grounding_score(a, e).alias("g"),
                c["covered"].alias("covered"),
                c["terms"].alias("terms"),
                F.when(c["terms"] > 0, c["covered"] / c["terms"]).otherwise(F.lit(0.0)).alias("r"),
            ),
        )

    nothing = F.struct(
        some.alias("any"), F.lit(0.0).alias("g"), F.lit(0).alias("covered"), F.lit(0).alias("terms"), F.lit(0.0).alias("r")
    )
    live = tx.bind(
        tx.tokenize(answer_text(answer)),
        lambda a: tx.bind(tx.tokenize(evidence_text(evidence)), lambda e: counted(a, e)),
    )
    return F.when(answer.isNotNull() & some, live).otherwise(nothing)


def _rule_tag(v, issues, s, grounding, coverage, enforce_g, enforce_c) -> Column:
    return (
        F.when(v.isNull(), "JSON_INVALID")
        .when(F.size(issues) > 0, "SCHEMA_INVALID")
        .when(enforce_g & ~(s["any"] & (s["g"] >= grounding)), "LOW_GROUNDING")
        .when(enforce_c & ~((s["terms"] > 0) & (s["r"] >= coverage)), "LOW_COVERAGE")
    )


def _outcome(tag, issues, answer, s, grounding, coverage, enforce_g, enforce_c) -> Column:
    g_msg = F.when(
        s["any"], F.format_string(f"GROUNDING_SCORE=%.3f (threshold={grounding})", s["g"])
    ).otherwise(F.lit("GROUNDING_SCORE=0.000 (no evidence)"))
    c_msg = (
        F.when(~s["any"], F.lit("COVERAGE_RATIO=0.000 (no evidence)"))
        .when(s["terms"] == 0, F.lit("COVERAGE_RATIO=0.000 (no key terms in output)"))
        .otherwise(F.format_string("COVERAGE_RATIO=%.3f (%d/%d terms covered)", s["r"], s["covered"], s["terms"]))
    )
    noted = lambda enforced, msg: F.when(enforced, msg).otherwise(F.concat(F.lit("[not enforced] "), msg))
    passed = F.array(F.lit("JSON_PARSE: OK"), F.lit("SCHEMA_CHECK: OK"))
    messages = (
        F.when(tag == "JSON_INVALID", F.array(F.lit("JSON parse failed")))
        .when(tag == "SCHEMA_INVALID", issues)
        .when(tag == "LOW_GROUNDING", F.concat(passed, F.array(g_msg)))
        .when(tag == "LOW_COVERAGE", F.concat(passed, F.array(noted(enforce_g, g_msg), c_msg)))
        .otherwise(F.concat(passed, F.array(noted(enforce_g, g_msg), noted(enforce_c, c_msg))))
    )
    early = F.coalesce(tag.isin("JSON_INVALID", "SCHEMA_INVALID"), F.lit(False))
    no_coverage = early | F.coalesce(tag == "LOW_GROUNDING", F.lit(False))
    return F.struct(
        F.when(tag.isNull(), "ALLOW").otherwise("BLOCK").alias("decision"),
        tag.alias("rule_tag"),
        F.when(early, F.lit(0.0)).otherwise(s["g"]).alias("grounding_score"),
        F.when(no_coverage, F.lit(0.0)).otherwise(s["r"]).alias("coverage_ratio"),
        messages.alias("messages"),
        F.when(tag.isNull(), answer).alias("validated_output"),
        F.when(tag.isNotNull(), F.lit(P.REFUSAL_DEFAULT)).alias("safe_refusal_message"),
    )


# --- rendering ------------------------------------------------------------------------


def useful(c: Column) -> Column:
    """The stripped text, or null when it is empty or says nothing."""
    s = tx.strip(F.coalesce(c, F.lit("")))
    return F.when(~F.lower(s).isin(P.TRIVIAL_VALUES), s)


def render_answer(answer: Column) -> Column:
    """Plain text of an answer: the direct form when there is a direct answer, else all parts."""
    direct, summary = useful(answer["direct_answer"]), useful(answer["summary"])
    mechanism, safety = useful(answer["mechanism_summary"]), useful(answer["safety_notes"])
    uses = F.filter(F.transform(answer["primary_indications"], useful), lambda x: x.isNotNull())
    para = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"\n{label}: "), c))
    safety_part = para("Safety information", safety)
    new_context = F.when(~F.contains(F.lower(direct), F.lower(summary)), para("Context", summary))
    uses_part = F.when(
        F.size(uses) > 0,
        F.concat(F.lit("\nPrimary uses:\n"), F.array_join(F.transform(uses, lambda u: F.concat(F.lit("  • "), u)), "\n")),
    )
    focused = F.array(direct, new_context, safety_part)
    full = F.array(summary, uses_part, para("How it works", mechanism), safety_part)
    parts = F.array_compact(F.when(direct.isNotNull(), focused).otherwise(full))
    body = F.concat(F.array_join(parts, "\n"), F.lit(f"\n\n{P.DISCLAIMER}"))
    return F.when(F.size(parts) > 0, tx.strip(body)).otherwise(F.lit(P.NO_CONTENT_TEXT))


def blocked_answer() -> Column:
    """The fixed answer object shown for a blocked query."""
    b = P.BLOCKED_ANSWER
    strings = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return F.struct(
        F.lit(None).cast("string").alias("direct_answer"),
        F.lit(b["summary"]).alias("summary"),
        strings(b["primary_indications"]).alias("primary_indications"),
        F.lit(b["mechanism_summary"]).alias("mechanism_summary"),
        F.lit(b["safety_notes"]).alias("safety_notes"),
        strings(b["tags"]).alias("tags"),
    )


def citations(evidence: Column) -> Column:
    """Citation structs: joined id, the first 300 characters, the retrieval score."""
    known = lambda c: F.coalesce(c, F.lit("unk"))
    return F.transform(
        evidence,
        lambda e: F.struct(
            F.concat_ws("_", known(e["drug_id"]), known(e["field_name"]), e["chunk_idx"].cast("string")).alias(
                "evidence_id"
            ),
            e["drug_id"].alias("drug_id"),
            e["drug_name"].alias("drug_name"),
            e["field_name"].alias("field_name"),
            F.substring(e["chunk_text"], 1, 300).alias("chunk_text"),
            F.coalesce(e["bm25_score"], F.lit(0.0)).alias("retrieval_score"),
        ),
    )


# --- modes and passes -------------------------------------------------------------------


def mode_table(spark) -> DataFrame:
    """The three modes and their flags."""
    return spark.createDataFrame(
        P.MODE_FLAGS,
        "model_mode string, retrieve_first boolean, check_grounding boolean, check_coverage boolean, self_correct boolean",
    )


def normalize_mode(mode: str) -> str:
    known = [m[0] for m in P.MODE_FLAGS]
    cleaned = (mode or "").strip().lower()
    if cleaned not in known:
        raise ValueError(f"mode must be one of {known}, got {mode!r}")
    return cleaned


def is_retriable(df_mode: Column, decision: Column, rule_tag: Column) -> Column:
    return (df_mode == "self_correcting") & (decision == "BLOCK") & F.coalesce(
        rule_tag.isin(P.RETRY_RULE_TAGS), F.lit(False)
    )


_RESULT = [*_DECISION, "content", "evidence"]


def resolve_passes(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Take the second pass for retriable blocks of the self-correcting mode.

    Both frames are decided passes keyed by ``keys``; at most two passes count.
    """
    again = second.select(*keys, F.struct(*_RESULT).alias("_second"))
    joined = first.join(again, keys, "left")
    retry = is_retriable(F.col("model_mode"), F.col("decision"), F.col("rule_tag")) & F.col("_second").isNotNull()
    kept = [c for c in first.columns if c not in _RESULT]
    tags = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    joined = joined.withColumn("_retry", retry)
    return joined.select(
        *kept,
        *[F.when(F.col("_retry"), F.col(f"_second.{c}")).otherwise(F.col(c)).alias(c) for c in _RESULT],
        F.when(F.col("_retry"), 2).otherwise(1).alias("guard_pass"),
        F.col("_retry").alias("correction_applied"),
        F.when(F.col("_retry"), F.col("rule_tag")).alias("correction_reason"),
        F.when(F.col("model_mode") == "self_correcting", tags(F.col("rule_tag"))).alias("first_pass_rule_tags"),
        F.when(
            F.col("model_mode") == "self_correcting",
            F.when(F.col("_retry"), tags(F.col("_second.rule_tag"))).otherwise(F.array().cast("array<string>")),
        ).alias("second_pass_rule_tags"),
        F.when(F.col("_retry"), F.col("content")).alias("initial_content"),
    )


def build_records(df: DataFrame, stamp: Column, model: str) -> DataFrame:
    """Final records: text to show, risk, refusal, citations, answer fields, correction columns."""
    allow = F.col("decision") == "ALLOW"
    refusal = F.coalesce("safe_refusal_message", F.lit(P.REFUSAL_DEFAULT))
    answer = F.col("validated_output")
    empty = F.array().cast("array<string>")
    scope_blocked = (
        F.coalesce(F.col("scope_tag").isNotNull(), F.lit(False)) if "scope_tag" in df.columns else F.lit(False)
    )
    return df.select(
        "*",
        stamp.alias("timestamp"),
        F.lit(model).alias("model"),
        F.when(allow, render_answer(answer)).otherwise(refusal).alias("final_text_response"),
        F.coalesce(answer["summary"], F.lit("")).alias("summary"),
        F.coalesce(answer["primary_indications"], empty).alias("primary_indications"),
        F.coalesce(answer["mechanism_summary"], F.lit("")).alias("mechanism_summary"),
        F.coalesce(answer["safety_notes"], F.lit("")).alias("safety_notes"),
        F.coalesce(answer["tags"], empty).alias("tags"),
        F.col("grounding_score").alias("confidence_score"),
        F.when(allow, "low").when(scope_blocked, "high").otherwise("blocked").alias("hallucination_risk"),
        F.when(F.col("rule_tag").isNull(), empty).otherwise(F.array("rule_tag")).alias("rule_tags"),
        citations(F.col("evidence")).alias("citations"),
        F.size("evidence").alias("evidence_count"),
        F.when(~allow, F.col("rule_tag")).alias("refusal_reason"),
    )


def missing_answers(prompts: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts without an answer become BLOCK / RETRIEVAL_FAILURE rows with zero scores."""
    joined = prompts.join(answered.withColumn("_there", F.lit(True)), keys, "left")
    gone = F.col("_there").isNull()
    return joined.withColumns(
        {
            "decision": F.when(gone, F.lit("BLOCK")).otherwise(F.col("decision")),
            "rule_tag": F.when(gone, F.lit("RETRIEVAL_FAILURE")).otherwise(F.col("rule_tag")),
            "grounding_score": F.when(gone, F.lit(0.0)).otherwise(F.col("grounding_score")),
            "coverage_ratio": F.when(gone, F.lit(0.0)).otherwise(F.col("coverage_ratio")),
        }
    ).drop("_there")


# --- three-way gate -----------------------------------------------------------------------


def confidence_action(df: DataFrame, query: str, confidence: str, minimum: float = P.GROUNDING_THRESHOLD) -> DataFrame:
    """Add action and reason: REFUSE by pattern, else WARN below the minimum, else ALLOW."""
    q = F.lower(query)
    dangerous = F.lit(False)
    for pattern in P.DANGEROUS_PATTERNS:
        dangerous = dangerous | tx.regex_find(q, pattern)
    low = F.col(confidence) < minimum
    return df.withColumns(
        {
            "action": F.when(dangerous, "REFUSE").when(low, "WARN").otherwise("ALLOW"),
            "reason": F.when(dangerous, "Medical advice / harm policy")
            .when(low, "Low confidence — insufficient evidence")
            .otherwise("Safe to answer"),
        }
    )


def best_allowed(df: DataFrame, query_id: str, confidence: str, key: str) -> DataFrame:
    """The allowed row of highest confidence (to three places) per query; ties by key."""
    others = [c for c in df.columns if c != query_id]
    order = F.struct((-F.round(confidence, 3)).alias("c"), F.col(key).alias("k"))
    best = df.where("action = 'ALLOW'").groupBy(query_id).agg(F.min_by(F.struct(*others), order).alias("r"))
    return best.select(query_id, *[F.col(f"r.{c}").alias(c) for c in others])
