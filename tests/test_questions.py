"""Questions in two passes: only the frontier goes back to the index."""

import pytest
from pyspark.sql import functions as F

from sievewell.operators import questions as qs

QUESTIONS = [
    (1, "What are the side effects of aspirin?"), (2, "What are the side effects of tea?"), (3, "Who won the match?"), (4, "What are the side effects of salt?"),
    (5, "What dose of aspirin should I take?"), (6, "What are the side effects of nothing?"),
]


def runs(spark):
    """A retriever that knows tea only by the expanded query, and a model that answers from the evidence."""
    asked = []

    def retrieve(q):
        asked.append(sorted((r["query_id"], r["query"]) for r in q.collect()))
        text = F.when(F.col("query").contains("aspirin"), "aspirin relieves headache pain fever").when(
            F.col("query").contains("tea?") & (F.length("query") > 45), "tea keeps people awake evenings"
        )
        text = F.coalesce(text, F.when(F.col("query").contains("salt"), "salt raises blood pressure slowly"))
        item = F.struct(F.lit("d").alias("drug_id"), F.lit("n").alias("drug_name"), F.lit("f").alias("field_name"), F.lit(0).alias("chunk_idx"), text.alias("chunk_text"), F.lit(1.0).alias("bm25_score"))
        return q.select("query_id", F.array(item).alias("evidence")).where(F.col("evidence")[0]["chunk_text"].isNotNull())

    def generate(made):
        text = F.coalesce(F.try_element_at("evidence", F.lit(1))["chunk_text"], F.lit("made up without evidence"))
        text = F.when(F.col("query").contains("salt"), F.lit("entirely different words spoken")).otherwise(text)
        return made.withColumn("content", F.to_json(F.struct(text.alias("summary"), F.lit("").alias("mechanism_summary"), F.lit("").alias("safety_notes"))))

    return asked, retrieve, generate


def test_only_the_frontier_is_retrieved_again(spark):
    asked, retrieve, generate = runs(spark)
    df = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    got = {r["query_id"]: r for r in qs.question_records(df, retrieve, generate, F.lit("t"), "m").collect()}
    assert [[i for i, _ in batch] for batch in asked] == [[1, 2, 4, 6], [2, 4, 6]]
    assert all(q.startswith(dict(QUESTIONS)[i]) and q != dict(QUESTIONS)[i] for i, q in asked[1])
    assert {i: (r["decision"], r["guard_pass"], r["hallucination_risk"]) for i, r in got.items()} == {
        1: ("ALLOW", 1, "low"), 2: ("ALLOW", 2, "low"), 3: ("BLOCK", 1, "high"), 4: ("BLOCK", 2, "blocked"), 5: ("BLOCK", 1, "high"), 6: ("BLOCK", 2, "blocked"),
    }
    assert got[2]["correction_reason"] == "LOW_GROUNDING" and got[2]["summary"] == "tea keeps people awake evenings" and got[2]["evidence_count"] == 1
    assert got[2]["first_pass_rule_tags"] == ["LOW_GROUNDING"] and got[2]["second_pass_rule_tags"] == [] and got[4]["second_pass_rule_tags"] == ["LOW_GROUNDING"]
    assert got[3]["rule_tags"] == ["OUT_OF_SCOPE_QUERY"] and got[3]["final_text_response"] and got[6]["citations"] == []


@pytest.mark.parametrize(("mode", "allowed"), [("rag", {1}), ("baseline", set())])
def test_other_modes_go_once(spark, mode, allowed):
    asked, retrieve, generate = runs(spark)
    df = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    got = qs.answered_questions(df, retrieve, generate, mode=mode).collect()
    assert {r["query_id"] for r in got if r["decision"] == "ALLOW"} == allowed
    assert {r["guard_pass"] for r in got} == {1} and not any(asked[1:][0] if asked[1:] else [])


def test_no_questions(spark):
    _, retrieve, generate = runs(spark)
    assert qs.answered_questions(spark.createDataFrame([], "query_id long, query string"), retrieve, generate).collect() == []
