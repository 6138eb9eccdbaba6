"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once cold; results are consumed by a no-op sink, so every row
and column is computed and nothing is fetched.
"""

from __future__ import annotations

import json
import os
import time

from sievewell.operators import retrieval as rt
from sievewell.operators.chunks import chunk_key
from sievewell.plans import plans
from sievewell.plans.texting import document_chunks
from sievewell.session import local_session, work_dir, written_once

HEADLINE = [
    # profiling and quality
    "mass_bin_counts", "daily_stats", "percentiles_exact", "null_rates", "lineitem_correlation", "price_histogram",
    "dedupe_by_id", "clean_messages", "rule_failure_counts", "quality_summary", "bad_rows_by_key",
    # text
    "token_counts", "document_chunks", "key_terms", "turn_tfidf_cosine",
    # retrieval over the stored index (its build is timed on its own)
    "bm25_search", "bm25_search_boosted", "tfidf_search", "verifier_scores",
    # splits and balancing
    "split_random", "split_temporal", "split_stratified", "perturbed_copies",
    # decisions, enrichment, evaluation
    "scope_check", "answer_decisions", "inference_records", "enrichment_scores", "overlap_metrics",
    "run_metrics", "threshold_sweep", "one_vs_rest_auc",
    # sources and streams
    "evidence_records", "incremental_pull", "stream_two_hops",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registry = plans()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    times: dict[str, float] = {}
    start = time.perf_counter()
    chunks = written_once(document_chunks(spark, sf).withColumn("key", chunk_key()), "bench-chunks")
    times["chunk_table_build"] = time.perf_counter() - start
    start = time.perf_counter()
    rt.save_index(chunks, "key", "chunk_text", work_dir(spark, "bench-index"))
    times["index_build"] = time.perf_counter() - start
    # The registered searches share stored tables; make them before the timing.
    from sievewell.plans import retrieving

    retrieving.stored(spark, sf)
    start = time.perf_counter()
    retrieving.stored_tfidf(spark, sf)
    times["tfidf_index_build"] = time.perf_counter() - start

    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - start
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": sf.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
