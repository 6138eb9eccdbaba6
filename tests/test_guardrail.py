"""Scope phrases, answer checks, rendering, passes and records."""

import json

import pytest

from conftest import rows
from pyspark.sql import functions as F
from sievewell.functions import patterns as P
from sievewell.operators import enrich as en
from sievewell.operators import guardrail as gr
from sievewell.operators import prompts as pm

EVIDENCE_TYPE = "array<struct<drug_id:string,drug_name:string,field_name:string,chunk_idx:int,chunk_text:string,bm25_score:double>>"
GOOD = {
    "summary": "Lepirudin is a thrombin inhibitor used in heparin induced thrombocytopenia.",
    "primary_indications": ["heparin induced thrombocytopenia"],
    "mechanism_summary": "It binds thrombin directly and blocks clotting.",
    "safety_notes": "Bleeding is the main risk.",
    "tags": ["anticoagulant"],
}
CHUNKS = [
    ("D1", "Lepirudin", "description", 0, "Lepirudin is a thrombin inhibitor used in heparin induced thrombocytopenia.", 2.0),
    ("D1", "Lepirudin", "mechanism", 1, "It binds thrombin directly and blocks clotting. Bleeding is the main risk.", 1.0),
]
OTHER = [("D2", "Other", "description", 0, "Completely different words about gardening tools and weather.", 1.0)]


def decide(spark, content, evidence=CHUNKS, **kw):
    text = content if isinstance(content, str) else json.dumps(content)
    df = spark.createDataFrame([(text, evidence)], f"content string, evidence {EVIDENCE_TYPE}")
    return gr.decide(df, **kw).first()


def test_grounded_answer_is_allowed(spark):
    r = decide(spark, GOOD)
    assert r["decision"] == "ALLOW" and r["rule_tag"] is None and r["safe_refusal_message"] is None
    assert r["grounding_score"] >= 0.45 and r["coverage_ratio"] >= 0.30
    assert r["validated_output"]["summary"] == GOOD["summary"] and len(r["messages"]) == 4


@pytest.mark.parametrize(
    "content, evidence, tag",
    [
        ("not json", CHUNKS, "JSON_INVALID"),
        ("", CHUNKS, "JSON_INVALID"),
        ({**GOOD, "summary": 5}, CHUNKS, "SCHEMA_INVALID"),
        ({**GOOD, "tags": None}, CHUNKS, "SCHEMA_INVALID"),
        ({**GOOD, "tags": ["a", 1]}, CHUNKS, "SCHEMA_INVALID"),
        ({k: v for k, v in GOOD.items() if k != "safety_notes"}, CHUNKS, "SCHEMA_INVALID"),
        ([GOOD], CHUNKS, "SCHEMA_INVALID"),  # TR8: no crash on a top-level list
        ("3", CHUNKS, "SCHEMA_INVALID"),
        (GOOD, [], "LOW_GROUNDING"),
        (GOOD, None, "LOW_GROUNDING"),
        (GOOD, OTHER, "LOW_GROUNDING"),
    ],
)
def test_blocks(spark, content, evidence, tag):
    r = decide(spark, content, evidence)
    assert (r["decision"], r["rule_tag"]) == ("BLOCK", tag)
    assert r["safe_refusal_message"] == P.REFUSAL_DEFAULT and r["validated_output"] is None and r["coverage_ratio"] == 0.0


def test_optional_parts(spark):
    assert decide(spark, {**GOOD, "direct_answer": None, "tags": []})["decision"] == "ALLOW"
    assert decide(spark, {**GOOD, "direct_answer": 3})["rule_tag"] == "SCHEMA_INVALID"


def test_fenced_json_counts(spark):
    # TR11: the fence is removed before parsing, everywhere
    assert decide(spark, "```json\n" + json.dumps(GOOD) + "\n```")["decision"] == "ALLOW"


def test_thresholds_and_flags(spark):
    assert decide(spark, GOOD, grounding=0.999)["rule_tag"] == "LOW_GROUNDING"
    # TR5: the coverage default is 0.30
    assert P.COVERAGE_THRESHOLD == 0.30
    r = decide(spark, GOOD, OTHER, check_grounding=False)
    assert r["rule_tag"] == "LOW_COVERAGE" and r["messages"][2].startswith("[not enforced] ")
    assert decide(spark, GOOD, OTHER, check_grounding=False, check_coverage=False)["decision"] == "ALLOW"


def scope(spark, q, pack="intended"):
    return spark.createDataFrame([(q,)], "q string").select(gr.scope_result(F.col("q"), pack).alias("s")).first()["s"]


@pytest.mark.parametrize("q", ["What is aspirin used for?", "Mechanism of ibuprofen", "drug interactions of warfarin", "Is this medication generic?"])
def test_in_scope(spark, q):
    assert not scope(spark, q)["blocked"]


@pytest.mark.parametrize(
    "q, tag",
    [
        ("What is the weather?", "OUT_OF_SCOPE_QUERY"),
        ("", "OUT_OF_SCOPE_QUERY"),
        (None, "OUT_OF_SCOPE_QUERY"),
        ("Do I have a drug allergy?", "OUT_OF_SCOPE_MEDICAL_ADVICE"),
        ("Prescribe me a drug", "SAFETY_POLICY_BLOCK"),
        ("How much aspirin should I take", "SAFETY_POLICY_BLOCK"),
        ("Can I take ibuprofen with my warfarin", "OUT_OF_SCOPE_MEDICAL_ADVICE"),
        ("lethal dose of a pill", "SAFETY_POLICY_BLOCK"),
    ],
)
def test_out_of_scope(spark, q, tag):
    s = scope(spark, q)
    assert s["blocked"] and s["rule_tag"] == tag and s["refusal_message"]


def test_compatible_pack_loses_words_with_blanks(spark):
    # TR4
    q = "What are the side effects of lepirudin?"
    assert not scope(spark, q)["blocked"]
    assert scope(spark, q, "compatible")["rule_tag"] == "OUT_OF_SCOPE_QUERY"
    assert not scope(spark, "sideeffects of it", "compatible")["blocked"]


def test_rendering(spark):
    def render(**kw):
        answer = {"direct_answer": None, "summary": "", "primary_indications": [], "mechanism_summary": "", "safety_notes": "", "tags": [], **kw}
        df = spark.createDataFrame([(answer,)], f"a {gr.ANSWER_TYPE}")
        return df.select(gr.render_answer(F.col("a")).alias("t")).first()["t"]

    full = render(summary="S.", primary_indications=["x", "n/a"], mechanism_summary="M.", safety_notes="Unknown")
    assert full == f"S.\n\nPrimary uses:\n  • x\n\nHow it works: M.\n\n{P.DISCLAIMER}"
    direct = render(direct_answer="Six hours.", summary="six hours", safety_notes="Care.")
    assert direct == f"Six hours.\n\nSafety information: Care.\n\n{P.DISCLAIMER}"
    assert "Context: Other" in render(direct_answer="Six hours.", summary="Other")
    assert render() == P.NO_CONTENT_TEXT
    assert render(direct_answer="N/A", summary="S.").startswith("S.")


def two_passes(spark, mode):
    schema = f"id int, model_mode string, content string, evidence {EVIDENCE_TYPE}"
    answers = [(1, json.dumps(GOOD), OTHER), (2, "bad", CHUNKS), (3, json.dumps(GOOD), CHUNKS)]
    first = spark.createDataFrame([(i, mode, c, e) for i, c, e in answers], schema)
    second = spark.createDataFrame([(i, mode, c, CHUNKS) for i, c, _ in answers], schema)
    passes = gr.resolve_passes(gr.decide(first), gr.decide(second), ["id", "model_mode"])
    return {r["id"]: r for r in passes.collect()}


def test_second_pass_only_for_retriable_blocks(spark):
    r = two_passes(spark, "self_correcting")
    assert (r[1]["decision"], r[1]["guard_pass"], r[1]["correction_reason"]) == ("ALLOW", 2, "LOW_GROUNDING")
    assert r[1]["first_pass_rule_tags"] == ["LOW_GROUNDING"] and r[1]["second_pass_rule_tags"] == []
    assert (r[2]["rule_tag"], r[2]["guard_pass"]) == ("JSON_INVALID", 1)
    assert (r[3]["decision"], r[3]["guard_pass"]) == ("ALLOW", 1)


def test_other_modes_have_one_pass(spark):
    r = two_passes(spark, "rag")
    assert (r[1]["decision"], r[1]["guard_pass"], r[1]["first_pass_rule_tags"]) == ("BLOCK", 1, None)


def test_modes():
    assert gr.normalize_mode(" RAG ") == "rag"
    with pytest.raises(ValueError):
        gr.normalize_mode("fast")


def test_records(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD), CHUNKS), (2, "x", OTHER)], f"id int, content string, evidence {EVIDENCE_TYPE}")
    r = {x["id"]: x for x in gr.build_records(gr.decide(df), F.lit("t"), "m").collect()}
    assert r[1]["hallucination_risk"] == "low" and r[1]["citations"][1]["evidence_id"] == "D1_mechanism_1"
    assert r[1]["evidence_count"] == 2 and r[1]["rule_tags"] == [] and GOOD["summary"] in r[1]["final_text_response"]
    assert r[2]["hallucination_risk"] == "blocked" and r[2]["final_text_response"] == P.REFUSAL_DEFAULT
    assert r[2]["refusal_reason"] == "JSON_INVALID" and r[2]["summary"] == ""


def test_missing_answer_becomes_a_blocked_row(spark):
    prompts = spark.createDataFrame([(1,), (2,)], "id int")
    answered = spark.createDataFrame([(1, "ALLOW", None, 0.9, 0.8)], "id int, decision string, rule_tag string, grounding_score double, coverage_ratio double")
    got = rows(gr.missing_answers(prompts, answered, ["id"]))
    assert got == [(1, "ALLOW", None, 0.9, 0.8), (2, "BLOCK", "RETRIEVAL_FAILURE", 0.0, 0.0)]


def test_confidence_gate(spark):
    df = spark.createDataFrame([("dosage of x", 0.9), ("what is x", 0.2), ("what is x", 0.45)], "q string, c double")
    got = [(r["action"]) for r in gr.confidence_action(df, "q", "c").collect()]
    assert got == ["REFUSE", "WARN", "ALLOW"]


def test_field_focus_takes_the_first_match(spark):
    focus = lambda q: spark.createDataFrame([(q,)], "q string").select(pm.field_focus(F.col("q")).alias("f")).first()["f"]
    assert focus("half-life and metabolism of x")["field"] == "half_life"
    assert focus("how does aspirin work")["field"] == "mechanism_of_action"
    assert focus("tell me more") is None


def test_enrichment_prompt_fills_absent_fields(spark):
    df = spark.createDataFrame([("Aspirin", ["a", "b"], None)], "name string, groups array<string>, indication string")
    text = df.select(pm.enrichment_prompt(df).alias("p")).first()["p"]
    assert "- Name: Aspirin\n" in text and "- Groups: a, b\n" in text and "- Indication: N/A\n" in text and '{\n  "summary": "string",' in text


def test_required_and_flagged_fields(spark):
    body = {"summary": " ", "primary_indications": [], "mechanism_summary": None, "safety_notes": "no side effects", "tags": ["100% safe"]}
    df = spark.createDataFrame([(json.dumps(body),)], "j string").select(F.try_parse_json("j").alias("v"))
    r = en.validate_enriched(df, "v").first()
    assert r["field_issues"] == ["Field summary is empty string", "Field primary_indications is empty list", "Field mechanism_summary is None"]
    assert len(r["hallucination_issues"]) == 2 and not r["valid"] and r["score"] == pytest.approx(0.3)
