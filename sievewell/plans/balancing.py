"""Class-balancing queries (G, J3)."""

from pyspark.sql import functions as F

from sievewell.operators import augment as ag
from sievewell.plans.base import plan, text_table

_BASE = """base AS (SELECT doc_id, lang || '-' || source AS label, lower(text) AS text FROM documents),
cnt AS (SELECT label, count(*) AS n FROM base GROUP BY 1),
p AS (SELECT label, n AS count, greatest(0, floor((SELECT max(n) FROM cnt) * 0.8) - n)::BIGINT AS need FROM cnt
   WHERE n <= (SELECT quantile_disc(n, 0.25) FROM cnt)),
plan AS (SELECT *, least(ceil(need::DOUBLE / count), 3)::BIGINT AS copies FROM p),
u AS (SELECT doc_id, label, text, rep, '42|' || doc_id || '|' || rep || '|text' AS seed, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w
   FROM base JOIN plan USING (label), unnest(range(1, copies + 1)) AS r(rep) WHERE copies > 0)"""


def _u(tail: str) -> str:
    return f"(('0x' || substr(md5(seed || '|{tail}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"


def _docs(spark, sf):
    return text_table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("-", "lang", "source").alias("label"), "text"
    )


@plan("replication_plan", "G1 G2 G3", f"WITH {_BASE} SELECT label, count, need, copies FROM plan")
def replication_plan(spark, sf):
    d = ag.replication_plan(ag.labelled(_docs(spark, sf), "label", ["text"]), "label")
    return d.withColumn("copies", F.col("copies").cast("bigint"))


@plan(
    "replicated_rows",
    "G4 J3",
    f"WITH {_BASE} SELECT doc_id, rep FROM u",
)
def replicated_rows(spark, sf):
    base = ag.labelled(_docs(spark, sf), "label", ["text"]).select("doc_id", "label")
    d = ag.replicate(base, ag.replication_plan(base, "label"), "label")
    return d.select("doc_id", F.col("rep").cast("bigint").alias("rep"))


@plan(
    "perturbed_copies",
    "G5",
    f"""WITH {_BASE}, x AS (SELECT *, len(w) AS n, floor({_u("i'")} * len(w))::BIGINT AS a, floor({_u("j'")} * len(w))::BIGINT AS b,
      list_filter(w, lambda t, i: (('0x' || substr(md5(seed || '|d|' || (i - 1)), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE) > 0.12) AS kept FROM u)
    SELECT doc_id, rep, md5(CASE WHEN n = 0 THEN text WHEN {_u("c'")} < 0.5 THEN array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE w END, ' ')
      ELSE array_to_string(list_transform(w, lambda t, i: CASE WHEN i - 1 = a THEN w[b + 1] WHEN i - 1 = b THEN w[a + 1] ELSE t END), ' ') END) AS text_md5 FROM x""",
)
def perturbed_copies(spark, sf):
    d = ag.balance(_docs(spark, sf), "label", "doc_id", ["text"]).where("rep > 0")
    return d.select("doc_id", F.col("rep").cast("bigint").alias("rep"), F.md5("text").alias("text_md5"))


@plan(
    "balance_report",
    "G6 U2",
    f"""WITH {_BASE} SELECT label, cnt.n AS before, cnt.n + coalesce(cnt.n * copies, 0)::BIGINT AS after FROM cnt LEFT JOIN plan USING (label)""",
)
def balance_report(spark, sf):
    return ag.balance_report(ag.balance(_docs(spark, sf), "label", "doc_id", ["text"]), "label")
