"""Questions end to end: scope, retrieval, generation, decision, and one more round for what was blocked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.operators import guardrail as gr
from sievewell.operators.prompts import expand_query
from sievewell.session import written_once

# (query_id, query) -> (query_id, evidence), at most one row for each question
Retrieve = Callable[[DataFrame], DataFrame]
# questions with query, evidence and strict -> the same rows with content
Generate = Callable[[DataFrame], DataFrame]

EVIDENCE_COLUMNS = ["drug_id", "drug_name", "field_name", "chunk_idx", "chunk_text"]
EVIDENCE = "array<struct<drug_id:string,drug_name:string,field_name:string,chunk_idx:int,chunk_text:string,bm25_score:double>>"


def answered_questions(
    questions: DataFrame,
    retrieve: Retrieve,
    generate: Generate,
    mode: str = "self_correcting",
    pack: str = "intended",
    grounding: float = P.GROUNDING_THRESHOLD,
    coverage: float = P.COVERAGE_THRESHOLD,
) -> DataFrame:
    """One decided row per question (query_id, query), with the pass that decided it.

    Questions out of scope are blocked unanswered. The others get evidence, an answer and a
    decision. In the self-correcting mode, answers that were blocked for want of grounding,
    coverage or evidence make the frontier: these questions alone are expanded, meet the index again,
    are answered strictly by the new evidence and decided once more, and then join their first pass by key.
    In the baseline mode the answer is made without evidence, which is fetched for the checks.

    Both passes are stored, so each is retrieved and generated once, and what is lost with an executor
    is read again. ``query_id`` must be unique. A question without evidence has an empty list.
    """
    mode = gr.normalize_mode(mode)
    retrieve_first, check_grounding, check_coverage, self_correct = next(flags for name, *flags in P.MODE_FLAGS if name == mode)
    scoped = written_once(gr.check_scope(questions.select("query_id", "query"), "query", pack), "scoped-questions")
    open_ = scoped.where("NOT scope.blocked").select("query_id", "query", F.col("query").alias("retrieval_query_used"))

    def answered(asked: DataFrame, strict: bool, purpose: str) -> DataFrame:
        found = retrieve(asked.select("query_id", F.col("retrieval_query_used").alias("query"))).select("query_id", F.col("evidence").cast(EVIDENCE).alias("evidence"))
        found = asked.join(found, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE)))
        seen = F.col("evidence") if retrieve_first else F.array().cast(EVIDENCE)
        made = generate(found.withColumns({"_evidence": F.col("evidence"), "evidence": seen, "strict": F.lit(strict)}))
        made = made.withColumn("evidence", F.col("_evidence")).drop("_evidence", "strict")
        return written_once(gr.decide(made, "content", "evidence", grounding, coverage, check_grounding, check_coverage), purpose)

    first = answered(open_, False, "first-pass").withColumn("model_mode", F.lit(mode))
    retriable = gr.is_retriable(F.col("model_mode"), F.col("decision"), F.col("rule_tag"))
    frontier = first.where(retriable if self_correct else F.lit(False)).select("query_id", "query", expand_query(F.col("query")).alias("retrieval_query_used"))
    second = answered(written_once(frontier, "frontier"), True, "second-pass")
    decided = gr.resolve_passes(first, second, ["query_id"]).drop("retrieval_query_used")
    used = second.select("query_id", F.col("retrieval_query_used").alias("_again"))
    decided = decided.join(used, "query_id", "left").withColumn("retrieval_query_used", F.coalesce("_again", "query")).drop("_again")
    decided = decided.withColumn("scope_tag", F.lit(None).cast("string"))

    blocked = scoped.where("scope.blocked").select(
        "query_id", "query", F.lit(mode).alias("model_mode"), F.lit("BLOCK").alias("decision"), F.col("scope.rule_tag").alias("rule_tag"),
        F.col("scope.rule_tag").alias("scope_tag"), F.col("scope.refusal_message").alias("safe_refusal_message"), F.lit(0.0).alias("grounding_score"),
        F.lit(0.0).alias("coverage_ratio"), F.array().cast(EVIDENCE).alias("evidence"), F.lit(1).alias("guard_pass"), F.lit(False).alias("correction_applied"),
    )
    return decided.unionByName(blocked, allowMissingColumns=True)


def question_records(questions: DataFrame, retrieve: Retrieve, generate: Generate, stamp, model: str, **options) -> DataFrame:
    """``answered_questions`` as final records: text to show, risk, refusal, citations and correction columns."""
    return gr.build_records(answered_questions(questions, retrieve, generate, **options), stamp, model)
