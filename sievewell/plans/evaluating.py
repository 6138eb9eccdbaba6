"""Evaluation queries (V, J7)."""

from pyspark.sql import functions as F

from sievewell.operators import evaluate as ev
from sievewell.plans.base import plan
from sievewell.plans.frames import EVAL_SQL, evals

_COUNTS = """count(*) FILTER (decision = 'ALLOW' AND should_allow) AS tp, count(*) FILTER (decision = 'ALLOW' AND NOT should_allow) AS fp,
  count(*) FILTER (decision <> 'ALLOW' AND NOT should_allow) AS tn, count(*) FILTER (decision <> 'ALLOW' AND should_allow) AS fn"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _rates(src: str, keep: str = "") -> str:
    pr = f"SELECT *, {_share('tp', 'tp + fp')} AS precision, {_share('tp', 'tp + fn')} AS recall FROM {src}"
    return f"SELECT *, {_share('2 * precision * recall', 'precision + recall')} AS f1, {_share('fp', 'fp + tn')} AS far, {_share('fn', 'tp + fn')} AS frr FROM ({pr})"


_RATE_COLS = ["precision", "recall", "f1", "far", "frr"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _RATE_COLS)


@plan("confusion_counts", "V1 TR9", f"WITH {EVAL_SQL} SELECT {_COUNTS} FROM evals")
def confusion_counts(spark, sf):
    return ev.confusion(evals(spark, sf))


@plan("decision_rates", "V2", f"WITH {EVAL_SQL}, c AS (SELECT {_COUNTS} FROM evals) SELECT {_ROUNDED} FROM ({_rates('c')})")
def decision_rates(spark, sf):
    return ev.rates(ev.confusion(evals(spark, sf))).select(*[F.round(c, 6).alias(c) for c in _RATE_COLS])


def _sweep(group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""sw AS (SELECT {g}threshold, count(*) FILTER (grounding_score >= threshold AND should_allow) AS tp, count(*) FILTER (grounding_score >= threshold AND NOT should_allow) AS fp,
      count(*) FILTER (grounding_score < threshold AND NOT should_allow) AS tn, count(*) FILTER (grounding_score < threshold AND should_allow) AS fn
      FROM evals, (SELECT CASE WHEN range = 20 THEN 1.0 ELSE range * (1.0::DOUBLE / 20) END AS threshold FROM range(21)) GROUP BY ALL),
    sweep AS (SELECT {g}threshold, {_share('tp', 'tp + fn')} AS tpr, {_share('fp', 'fp + tn')} AS fpr, {_share('fp', 'fp + tn')} AS far,
      {_share('fn', 'tp + fn')} AS frr, {_share('tp', 'tp + fp')} AS precision FROM sw)"""


_SWEEP_COLS = ["threshold", "tpr", "fpr", "far", "frr", "precision"]


@plan("threshold_sweep", "V3", f"WITH {EVAL_SQL}, {_sweep()} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _SWEEP_COLS)} FROM sweep")
def threshold_sweep(spark, sf):
    return ev.roc_sweep(evals(spark, sf)).select(*[F.round(c, 6).alias(c) for c in _SWEEP_COLS])


@plan("best_threshold", "V4", f"WITH {EVAL_SQL}, {_sweep()} SELECT round(threshold, 6) AS optimal_threshold FROM sweep ORDER BY tpr - fpr DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return ev.best_threshold(ev.roc_sweep(evals(spark, sf))).select(
        F.round("optimal_threshold", 6).alias("optimal_threshold")
    )


_RUN = f"""count(*) AS num_samples, avg(CASE WHEN json_valid(content) THEN 1.0 ELSE 0.0 END) AS jsvs,
  avg(CASE WHEN json_valid(content) AND doc_id % 13 <> 0 THEN 1.0 ELSE 0.0 END) AS smr, avg(CASE WHEN decision = 'ALLOW' THEN 1.0 ELSE 0.0 END) AS allow_rate,
  avg(CASE WHEN decision <> 'ALLOW' THEN 1.0 ELSE 0.0 END) AS block_rate, avg(grounding_score) AS grounding_mean, stddev_pop(grounding_score) AS grounding_std,
  avg(coverage_ratio) AS coverage_mean, avg(CASE WHEN rule_tag = 'LOW_GROUNDING' THEN 1.0 ELSE 0.0 END) AS grounding_failure_rate,
  avg(latency_ms) AS latency_mean_ms, quantile_cont(latency_ms, 0.95) AS latency_p95_ms,
  'LOW_COVERAGE=' || count(*) FILTER (rule_tag = 'LOW_COVERAGE') || ',LOW_GROUNDING=' || count(*) FILTER (rule_tag = 'LOW_GROUNDING') AS rule_breakdown, {_COUNTS}"""
_RUN_COLS = [
    "jsvs", "smr", "allow_rate", "block_rate", "grounding_mean", "grounding_std", "coverage_mean",
    "grounding_failure_rate", "latency_mean_ms", "latency_p95_ms", "optimal_threshold", *_RATE_COLS,
]
_RUN_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _RUN_COLS)


def _tidy(d, *keys):
    tags = F.array_join(
        F.transform(F.map_entries("rule_breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return d.select(
        *keys, "num_samples", *ev.CONFUSION, tags.alias("rule_breakdown"), *[F.round(c, 6).alias(c) for c in _RUN_COLS]
    )


@plan(
    "run_metrics",
    "V5 TR19",
    f"""WITH {EVAL_SQL}, {_sweep()}, c AS (SELECT {_RUN}, (SELECT threshold FROM sweep ORDER BY tpr - fpr DESC, threshold LIMIT 1) AS optimal_threshold FROM evals)
    SELECT num_samples, tp, fp, tn, fn, rule_breakdown, {_RUN_ROUNDED} FROM ({_rates('c')})""",
)
def run_metrics(spark, sf):
    return _tidy(ev.run_metrics(evals(spark, sf)))


@plan(
    "mode_metrics",
    "V6 D9",
    f"""WITH {EVAL_SQL}, {_sweep('model_mode')}, b AS (SELECT model_mode, threshold AS optimal_threshold FROM sweep QUALIFY row_number() OVER (PARTITION BY model_mode ORDER BY tpr - fpr DESC, threshold) = 1),
    c AS (SELECT e.*, optimal_threshold FROM (SELECT model_mode, {_RUN} FROM evals GROUP BY 1) e JOIN b USING (model_mode))
    SELECT model_mode, num_samples, tp, fp, tn, fn, rule_breakdown, {_RUN_ROUNDED} FROM ({_rates('c')})""",
)
def mode_metrics(spark, sf):
    return _tidy(ev.run_metrics(evals(spark, sf), by="model_mode"), "model_mode")


def _two_runs(spark, sf):
    """Rates of two modes as (metric, value) tables; each lacks one metric."""
    rates = ev.rates(ev.confusion(evals(spark, sf), by=["model_mode"]))
    a = ev.long_metrics(rates.where("model_mode = 'baseline'"), ["precision", "recall", "f1", "far"])
    b = ev.long_metrics(rates.where("model_mode = 'rag'"), ["precision", "recall", "f1", "frr"])
    return ev.compare_metrics(a, b)


_TWO_RUNS_SQL = f"""{EVAL_SQL}, c AS (SELECT model_mode, {_COUNTS} FROM evals GROUP BY 1), r AS ({_rates('c')}),
  a AS (UNPIVOT (SELECT precision, recall, f1, far FROM r WHERE model_mode = 'baseline') ON COLUMNS(*) INTO NAME metric VALUE value),
  b AS (UNPIVOT (SELECT precision, recall, f1, frr FROM r WHERE model_mode = 'rag') ON COLUMNS(*) INTO NAME metric VALUE value),
  cmp AS (SELECT coalesce(a.metric, b.metric) AS metric, a.value AS baseline, b.value AS candidate, round(b.value - a.value, 4) AS difference FROM a FULL JOIN b ON a.metric = b.metric),
  cmpd AS (SELECT *, CASE WHEN difference > 0 THEN 'improved' WHEN difference < 0 THEN 'declined' WHEN difference = 0 THEN 'unchanged' END AS change FROM cmp)"""


@plan(
    "compared_runs",
    "V10 J7",
    f"WITH {_TWO_RUNS_SQL} SELECT metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, difference, change FROM cmpd",
)
def compared_runs(spark, sf):
    return _two_runs(spark, sf).withColumns({c: F.round(c, 6) for c in ("baseline", "candidate")})


@plan(
    "compared_run_changes",
    "V10",
    f"""WITH {_TWO_RUNS_SQL} SELECT coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (change = 'improved'), '') AS improved,
    coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (change = 'declined'), '') AS declined FROM cmpd""",
)
def compared_run_changes(spark, sf):
    return ev.change_lists(_two_runs(spark, sf)).select("improved", "declined")


@plan(
    "running_allows",
    "V11",
    f"""WITH {EVAL_SQL}, w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seen, sum((decision = 'ALLOW')::INT) OVER (ORDER BY doc_id)::BIGINT AS allowed FROM evals)
    SELECT doc_id, seen, allowed, round(allowed::DOUBLE / seen, 6) AS allow_rate FROM w WHERE seen % 10 = 0""",
)
def running_allows(spark, sf):
    return ev.running_allows(evals(spark, sf), "doc_id").withColumn("allow_rate", F.round("allow_rate", 6))


@plan(
    "score_distribution",
    "A16",
    f"""WITH {EVAL_SQL}, e AS (SELECT min(latency_ms) AS lo, max(latency_ms) AS hi FROM evals),
    c AS (SELECT least(floor((latency_ms - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS row_count FROM evals, e GROUP BY 1)
    SELECT r.bin, coalesce(row_count, 0) AS row_count FROM (SELECT range AS bin FROM range(20)) r LEFT JOIN c USING (bin)""",
)
def score_distribution(spark, sf):
    from sievewell.operators.profile import histogram

    return histogram(evals(spark, sf), "latency_ms", 20).select("bin", "row_count")
