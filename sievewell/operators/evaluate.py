"""Evaluation of decisions and of enriched records."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.functions import text as tx
from sievewell.operators.guardrail import decide, parse_answer, schema_issues
from sievewell.operators.ranking import count_and_quantiles, grouped_quantiles, running_totals

CONFUSION = ["tp", "fp", "tn", "fn"]


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_aggs(decision: str = "decision", label: str = "should_allow") -> list[Column]:
    allow, good = F.col(decision) == "ALLOW", F.col(label)
    return [
        F.count_if(allow & good).alias("tp"),
        F.count_if(allow & ~good).alias("fp"),
        F.count_if(~allow & ~good).alias("tn"),
        F.count_if(~allow & good).alias("fn"),
    ]


def confusion(df: DataFrame, decision: str = "decision", label: str = "should_allow", by: list[str] | None = None):
    return df.groupBy(*(by or [])).agg(*confusion_aggs(decision, label))


def rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1, far and frr; a zero denominator gives zero."""
    tp, fp, tn, fn = [F.col(c) for c in CONFUSION]
    d = counts.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return d.withColumns({"f1": _share(2 * p * r, p + r), "far": _share(fp, fp + tn), "frr": _share(fn, tp + fn)})


def roc_sweep(
    df: DataFrame, score: str = "grounding_score", label: str = "should_allow", points: int = 21, by: str | None = None
) -> DataFrame:
    """Rates at evenly spaced thresholds from 0 to 1, allowing scores at or above each.

    Scores are first reduced to counts per threshold slot, at most ``points + 1``
    rows per group; the cumulative sums run over those.
    """
    group = [by] if by else []
    step = 1.0 / (points - 1)
    cuts = [i * step for i in range(points - 1)] + [1.0]
    slot = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda t: t <= F.col(score)))
    slots = df.groupBy(*group, slot.alias("slot")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    at = F.posexplode(F.array(*[F.lit(c) for c in cuts])).alias("i", "threshold")
    # Slot s counts for every threshold with position below s.
    reached = slots.select(*group, "slot", "pos", "neg", at)
    sums = reached.groupBy(*group, "i", "threshold").agg(
        *[F.sum(F.when(F.col("slot") > F.col("i"), F.col(c)).otherwise(0)).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))],
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
    )
    tp, fp, pos, neg = [F.col(c) for c in ("tp", "fp", "all_pos", "all_neg")]
    return sums.select(
        *group,
        "threshold",
        _share(tp, pos).alias("tpr"),
        _share(fp, neg).alias("fpr"),
        _share(fp, neg).alias("far"),
        _share(pos - tp, pos).alias("frr"),
        _share(tp, tp + fp).alias("precision"),
    )


def best_threshold(sweep: DataFrame, by: str | None = None) -> DataFrame:
    """The threshold of the largest tpr - fpr; the smallest one on ties."""
    j = F.col("tpr") - F.col("fpr")
    return sweep.groupBy(*([by] if by else [])).agg(
        F.max_by("threshold", F.struct(j.alias("j"), (-F.col("threshold")).alias("t"))).alias("optimal_threshold")
    )


def run_metrics(
    df: DataFrame, by: str | None = None, latency: str = "latency_ms", content: str = "content"
) -> DataFrame:
    """One row of run metrics, or one per value of ``by`` (such as the mode).

    The latency percentile is exact by rank selection, for all groups at once.
    """
    group = [by] if by else []
    if by:  # a run without a mode is one of the usual kind
        df = df.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("rag")))
    parsed = df.withColumn("_v", parse_answer(F.col(content)))
    parsed = parsed.withColumn("_ok", F.col("_v").isNotNull() & (F.size(schema_issues(F.col("_v"))) == 0))
    n = F.count("*")
    base = parsed.groupBy(*group).agg(
        n.alias("num_samples"),
        (F.count_if(F.col("_v").isNotNull()) / n).alias("jsvs"),
        (F.count_if("_ok") / n).alias("smr"),
        (F.count_if(F.col("decision") == "ALLOW") / n).alias("allow_rate"),
        (F.count_if(F.col("decision") != "ALLOW") / n).alias("block_rate"),
        F.avg("grounding_score").alias("grounding_mean"),
        F.stddev_pop("grounding_score").alias("grounding_std"),
        F.avg("coverage_ratio").alias("coverage_mean"),
        (F.count_if(F.col("rule_tag") == "LOW_GROUNDING") / n).alias("grounding_failure_rate"),
        F.avg(latency).alias("latency_mean_ms"),
        *confusion_aggs(),
    )
    out = rates(base)
    best = best_threshold(roc_sweep(df, by=by), by)
    tags = df.where(F.col("rule_tag").isNotNull()).groupBy(*group, "rule_tag").agg(F.count("*").alias("n"))
    breakdown = tags.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_tag", "n")))).alias("rule_breakdown")
    )
    if not by:
        p95 = count_and_quantiles(df, latency, [0.95])[1][0]
        out = out.select(
            "*",
            best.select("optimal_threshold").scalar().alias("optimal_threshold"),
            breakdown.select("rule_breakdown").scalar().alias("rule_breakdown"),
            F.lit(p95).cast("double").alias("latency_p95_ms"),
        )
        if "model_mode" in df.columns:
            modes = df.agg(
                F.when(F.min("model_mode") == F.max("model_mode"), F.min("model_mode")).alias("model_mode")
            )
            out = out.withColumn("model_mode", modes.scalar())
        return out
    late = grouped_quantiles(df, by, latency, {"latency_p95_ms": 0.95}).drop("n")
    return out.join(best, by, "left").join(breakdown, by, "left").join(late, by, "left")


def completeness(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows (field, before, after): shares of filled values in the raw and the enriched record."""
    share = lambda filled: F.avg(F.when(F.coalesce(filled, F.lit(False)), 1.0).otherwise(0.0))
    one = df.agg(
        *[
            F.struct(F.lit(f).alias("field"), share(b).alias("before"), share(a).alias("after")).alias(f)
            for f, (b, a) in fields.items()
        ]
    )
    return one.select(F.inline(F.array(*[F.col(f) for f in fields])))


def overlap_metrics(df: DataFrame, raw_text: Column, answer_text: Column, threshold: float = P.OVERLAP_HALLUCINATION_THRESHOLD):
    """(hdm, fce_mean_jaccard): share of records whose word overlap is low, and the mean overlap."""
    sim = tx.jaccard(tx.words(raw_text), tx.words(answer_text))
    d = df.select(sim.alias("sim"))
    return d.agg(
        F.avg(F.when(F.col("sim") < threshold, 1.0).otherwise(0.0)).alias("hdm"), F.avg("sim").alias("fce_mean_jaccard")
    )


def throughput(df: DataFrame, processed_at: str) -> DataFrame:
    """Records per minute over the span of readable time stamps; all records count."""
    t = F.col(processed_at)
    if dict(df.dtypes)[processed_at] == "string":
        t = F.try_to_timestamp(t)
    seconds = F.unix_micros(t.cast("timestamp")) / 1e6
    span = F.greatest(F.max(seconds) - F.min(seconds), F.lit(1e-9))
    return df.agg((F.count("*") / (span / 60.0)).alias("records_per_min"))


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outer join of two (metric, value) tables with the difference rounded to 4 places."""
    left, right = a.withColumnRenamed("value", "baseline"), b.withColumnRenamed("value", "candidate")
    joined = left.join(right, "metric", "full")
    diff = F.round(F.col("candidate") - F.col("baseline"), 4)
    return joined.select(
        "metric",
        "baseline",
        "candidate",
        diff.alias("difference"),
        F.when(diff > 0, "improved").when(diff < 0, "declined").when(diff == 0, "unchanged").alias("change"),
    )


def change_lists(compared: DataFrame) -> DataFrame:
    """One row: the improved and the declined metrics by name, and the better side for accuracy and F1."""
    names = lambda what: F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("change") == what, F.col("metric")))), ", "
    )
    better = lambda m: F.max(
        F.when(F.col("metric") == m, F.when(F.col("difference") > 0, "candidate").otherwise("baseline"))
    )
    return compared.agg(
        names("improved").alias("improved"),
        names("declined").alias("declined"),
        better("accuracy").alias("better_accuracy"),
        better("f1_macro").alias("better_f1"),
    )


def fill_decisions(df: DataFrame, content: str = "content", evidence: str = "evidence", **checks) -> DataFrame:
    """Records with what they lack of decision, rule tag and scores taken from a new check of the answer."""
    names = ["decision", "rule_tag", "grounding_score", "coverage_ratio"]
    kept = df.withColumns({f"_recorded_{c}": F.col(c) for c in names})
    checked = decide(kept, content, evidence, **checks)
    filled = checked.withColumns({c: F.coalesce(f"_recorded_{c}", c) for c in names})
    return filled.select(*df.columns)


def enrichment_metrics(
    df: DataFrame, valid: Column, raw_text: Column, answer_text: Column, processed_at: str, latency_ms: Column | None = None
) -> DataFrame:
    """One row for a run of enriched records: validity, overlap, latency, throughput.

    JSON validity and schema match are the same count here: the answers are
    already structured. A negative latency is no measurement.
    """
    lat = latency_ms if latency_ms is not None else F.lit(None).cast("double")
    base = df.agg(
        F.count("*").alias("num_records"),
        F.avg(F.when(valid, 1.0).otherwise(0.0)).alias("jsvs"),
        F.avg(F.when(valid, 1.0).otherwise(0.0)).alias("smr"),
        F.avg(F.when(lat >= 0, lat)).alias("latency_ms_mean"),
    )
    overlap = overlap_metrics(df, raw_text, answer_text)
    both = overlap.select(F.struct("hdm", "fce_mean_jaccard").alias("o"))
    return base.select("*", both.scalar().alias("o"), throughput(df, processed_at).scalar().alias("records_per_min")).select(
        "num_records", "jsvs", "smr", "o.hdm", "o.fce_mean_jaccard", "latency_ms_mean", "records_per_min"
    )


def running_allows(df: DataFrame, order_col: str, every: int = 10) -> DataFrame:
    """Rows seen, allowed so far and the rate, at every ``every``-th row in order."""
    out = running_totals(
        df.select(order_col, "decision"),
        order_col,
        {"seen": F.lit(1), "allowed": (F.col("decision") == "ALLOW").cast("int")},
    )
    at = out.where(F.col("seen") % every == 0)
    return at.select(order_col, "seen", "allowed", (F.col("allowed") / F.col("seen")).alias("allow_rate"))


def long_metrics(one_row: DataFrame, cols: list[str]) -> DataFrame:
    """(metric, value) rows of a one-row frame."""
    casted = one_row.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot([], cols, "metric", "value")
