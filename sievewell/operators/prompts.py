"""Prompt texts: field focus, evidence prompts, enrichment prompts, generated questions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.functions import text as tx
from sievewell.operators.augment import uniform
from sievewell.operators.ranking import hash_row_numbers


def field_focus(query: Column) -> Column:
    """struct(field, label) of the first focus pattern found in the query, else null."""
    rules = [
        (tx.regex_find(query, pattern), F.struct(F.lit(field).alias("field"), F.lit(label).alias("label")))
        for field, pattern, label in P.FIELD_FOCUS
    ]
    return tx.first_match(rules, F.lit(None))


def expand_query(query: Column) -> Column:
    """The query with the fixed words that widen the second retrieval."""
    return tx.strip(F.concat_ws(" ", tx.strip(query), F.lit(P.RETRY_TAIL)))


# Wording of the query prompt.
_HEAD = "Return ONLY a single valid JSON object matching this schema exactly (no markdown, no extra text):"
_RULES_BASE = (
    "RULES:\n"
    "- summary, mechanism_summary, safety_notes are REQUIRED.\n"
    "- direct_answer is OPTIONAL — leave as empty string unless answering a specific factoid.\n"
    '- Write "Not specified" when uncertain — do NOT invent clinical details.\n'
    "- Do NOT provide dosing instructions, prescribing advice, or patient-specific guidance.\n"
)
_RULES_EVIDENCE = (
    "RULES:\n"
    "- summary, mechanism_summary, safety_notes are REQUIRED.\n"
    "- direct_answer is OPTIONAL but PREFERRED for factoid questions; leave as empty string otherwise.\n"
    "- Be concise. Do NOT pad with background the user did not ask for.\n"
    "- Base every clinical claim ONLY on the Evidence section below.\n"
    "- Do NOT hallucinate or add information absent from the evidence.\n"
    '- Write "Not specified" when the evidence does not cover a detail.\n'
    "- Do NOT provide dosing instructions, prescribing advice, or patient-specific guidance.\n"
)
_FOCUS = (
    "\nFOCUS:\n"
    "- The user is asking specifically about: {label}.\n"
    '- Look in the Evidence below for chunks whose Field is "{field}".\n'
    "- If such evidence exists, write a SHORT (1-2 sentence) factoid in `direct_answer`,\n"
    "  quoting the specific value(s) from those chunks. Do NOT pad with general drug background.\n"
    "- If no such evidence is present, set `direct_answer` to an empty string and answer normally.\n"
)
_STRICT = (
    "\nSTRICT MODE: Every clinical claim MUST appear in the Evidence below. "
    "Write 'Not specified' for anything not supported by the evidence.\n"
)
_OPEN_BASE = "You are answering a drug information query for an educational system."
_OPEN_EVIDENCE = (
    "You are answering a drug information query using retrieved evidence from a curated DrugBank database."
)
_CLOSE = "\n\nJSON output only:"
_NO_EVIDENCE = "(no evidence retrieved)"


def focus_block(focus: Column) -> Column:
    label_head, rest = _FOCUS.split("{label}")
    field_head, tail = rest.split("{field}")
    filled = F.concat(F.lit(label_head), focus["label"], F.lit(field_head), focus["field"], F.lit(tail))
    return F.when(focus.isNotNull(), filled).otherwise(F.lit(""))


def evidence_block(evidence: Column) -> Column:
    entry = lambda e: F.concat(
        F.lit("Drug: "), F.coalesce(e["drug_name"], F.lit("Unknown")),
        F.lit("\nField: "), F.coalesce(e["field_name"], F.lit("N/A")),
        F.lit("\nContent: "), F.coalesce(e["chunk_text"], F.lit("")),
    )
    return F.when(F.size(evidence) > 0, F.array_join(F.transform(evidence, entry), "\n\n")).otherwise(
        F.lit(_NO_EVIDENCE)
    )


def build_prompt_col(
    query: Column, evidence: Column | None, focus: Column, strict: Column | bool = False
) -> Column:
    """The generation prompt; without evidence the form that gives no context."""
    if evidence is None:
        opening = f"{_OPEN_BASE}\n\n{_HEAD}\n\n{P.ANSWER_SCHEMA_BLOCK}\n\n{_RULES_BASE}"
        return F.concat(F.lit(opening), focus_block(focus), F.lit("\nQuery: "), query, F.lit(_CLOSE))
    opening = f"{_OPEN_EVIDENCE}\n\n{_HEAD}\n\n{P.ANSWER_SCHEMA_BLOCK}\n\n{_RULES_EVIDENCE}"
    strict_col = F.lit(strict) if isinstance(strict, bool) else strict
    return F.concat(
        F.lit(opening),
        focus_block(focus),
        F.when(strict_col, F.lit(_STRICT)).otherwise(F.lit("")),
        F.lit("\nQuery: "),
        query,
        F.lit("\n\nEvidence:\n"),
        evidence_block(evidence),
        F.lit(_CLOSE),
    )


# Wording of the two enrichment prompts; names in braces are columns.
ENRICHMENT_PROMPT = """You are helping to enrich DrugBank records for an enterprise guardrail system.

You MUST return ONLY a single valid JSON object that follows this exact schema
and field names (no markdown, no backticks, no explanations):

{{
  "summary": "string",
  "primary_indications": ["string", ...],
  "mechanism_summary": "string",
  "safety_notes": "string",
  "tags": ["string", ...]
}}

Hard requirements (very important):
- Every field is REQUIRED. Never return an empty string "" or an empty list [].
- If the source data does not mention something, write a short phrase like "Not specified".
- "primary_indications": include 2–4 specific conditions or use-cases, in plain language.
- "tags": include 3–6 short, lower-case tags like "antibiotic", "cardiology", "oral", etc.
- Keep all text factual and grounded in the provided drug data. If unsure, say "Not specified" rather than guessing.

Drug Data:
- Drug ID: {drug_id}
- Name: {name}
- CAS: {cas_number}
- Groups: {groups}
- Synonyms: {synonyms}

- Indication: {indication}
- Mechanism of Action: {mechanism_of_action}
- Pharmacodynamics: {pharmacodynamics}
- Description: {description}

Now output the JSON object ONLY, with no extra text."""

SHORT_ENRICHMENT_PROMPT = """You are helping to enrich DrugBank records.

Return ONLY valid JSON (no markdown):

{{
  "summary": "string",
  "primary_indications": ["string", ...],
  "mechanism_summary": "string",
  "safety_notes": "string",
  "tags": ["string", ...]
}}

Rules: all fields required, use "Not specified" when uncertain.

Drug: {name} ({drug_id})
Indication: {indication}
Mechanism: {mechanism_of_action}
Description: {description}

JSON only:"""

# What stands in the prompt for an absent field.
_PROMPT_DEFAULTS = {
    "drug_id": "unknown_id",
    "name": "Unknown drug",
    "cas_number": "N/A",
    "groups": "",
    "synonyms": "",
    "indication": "N/A",
    "mechanism_of_action": "N/A",
    "pharmacodynamics": "N/A",
    "description": "N/A",
}


def enrichment_prompt(df: DataFrame, template: str = ENRICHMENT_PROMPT) -> Column:
    """Fill a template from the columns of the record; lists are joined by commas."""
    types = dict(df.dtypes)

    def value(slot: str) -> Column:
        default = F.lit(_PROMPT_DEFAULTS[slot])
        if slot not in types:
            return default
        if types[slot].startswith("array"):
            return F.coalesce(F.array_join(slot, ", "), default)
        return F.coalesce(F.col(slot).cast("string"), default)

    pieces = []
    for literal, slot, _, _ in Formatter().parse(template):
        pieces.append(F.lit(literal))
        if slot:
            pieces.append(value(slot))
    return F.concat(*pieces)


def generate_prompts(records: DataFrame, id_col: str, name_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` templated questions; record and template are picked by seeded hashes.

    Records are numbered in hash order by blocks, so no task sees them all.
    """
    spark = records.sparkSession
    numbered = hash_row_numbers(records.select(id_col, name_col), id_col, seed)
    total = records.agg(F.count("*")).scalar()
    number = F.col("prompt_id").cast("string")
    templates = F.array(*[F.struct(F.lit(t).alias("query_type"), F.lit(q).alias("template")) for t, q in P.PROMPT_TEMPLATES])
    picks = spark.range(n).select(
        F.col("id").alias("prompt_id")
    ).select(
        "prompt_id",
        F.floor(uniform(str(seed), "record", number) * total).cast("bigint").alias("row_number"),
        F.get(templates, F.floor(uniform(str(seed), "template", number) * len(P.PROMPT_TEMPLATES)).cast("int")).alias("t"),
    )
    name = F.coalesce(tx.strip(tx.blank_to_null(F.col(name_col))), F.lit("Unknown"))
    ident = F.coalesce(tx.strip(tx.blank_to_null(F.col(id_col).cast("string"))), F.lit("unknown"))
    return picks.join(numbered, "row_number").select(
        "prompt_id",
        ident.alias("drug_id"),
        name.alias("drug_name"),
        F.replace(F.col("t.template"), F.lit("{name}"), name).alias("query"),
        F.col("t.query_type").alias("query_type"),
        name.alias("expected_drug"),
    )
