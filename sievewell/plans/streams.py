"""Streaming queries (S12, S13, K8, K9, X)."""

from functools import cache

from pyspark.sql import functions as F

from sievewell.plans.base import data_version, plan
from sievewell.plans.frames import MESSAGES_SQL, messages
from sievewell.session import work_dir
from sievewell.sources.files import path_exists
from sievewell.streaming import streams as sm

CLEANED_SQL = f"""m AS ({MESSAGES_SQL}), j AS (SELECT event_id, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM m),
cleaned AS (SELECT v->>'$.id' AS id, CASE WHEN json_exists(v, '$.source') THEN v->>'$.source' ELSE 'unknown' END AS source, v->>'$.text' AS text FROM j WHERE json_type(v, '$.text') = 'VARCHAR')"""


@cache
def _topic(app_id: str, version: str, spark, sf: str) -> str:
    """The messages as a folder of text files, the stand-in for a topic."""
    path = work_dir(spark, "topic")
    messages(spark, sf).repartition(6, "event_id").select("value").write.text(path)
    return path


def topic(spark, sf):
    return _topic(spark.sparkContext.applicationId, data_version(spark, sf, "events"), spark, sf)


@plan(
    "stream_to_partitioned_parquet",
    "S12 K8 X1",
    f"""WITH m AS ({MESSAGES_SQL}), j AS (SELECT CASE WHEN json_valid(value) THEN value::JSON END AS v FROM m)
    SELECT '2025-01-01' AS dt, v->>'$.source' AS source, count(*) AS row_count FROM j GROUP BY 1, 2""",
)
def stream_to_partitioned_parquet(spark, sf):
    out, check = work_dir(spark, "stream-out"), work_dir(spark, "stream-check")
    parsed = sm.json_stream(spark, "text", sm.EVENT_SCHEMA, path=topic(spark, sf), maxFilesPerTrigger=2)
    landed = sm.with_landing_date(parsed, F.lit("2025-01-01"))
    sm.start_sink(landed, out, check, ["dt"]).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("dt").cast("string").alias("dt"), "source").agg(F.count("*").alias("row_count"))


@plan("stream_idempotent_sink", "K9 X2", f"WITH m AS ({MESSAGES_SQL}) SELECT count(*) AS row_count, count(DISTINCT value) AS messages FROM m")
def stream_idempotent_sink(spark, sf):
    out, check = work_dir(spark, "idem-out"), work_dir(spark, "idem-check")
    raw = sm.message_stream(spark, "text", path=topic(spark, sf), maxFilesPerTrigger=2)
    for _ in range(2):  # the second start finds nothing to do
        sm.start_idempotent_sink(raw, out, check).awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("row_count"), F.countDistinct("value").alias("messages"))


@plan("stream_landed_envelopes", "S13", f"WITH m AS ({MESSAGES_SQL}) SELECT value, '2025-01-01T00:00:00' AS ts FROM m")
def stream_landed_envelopes(spark, sf):
    out, check = work_dir(spark, "landed"), work_dir(spark, "landed-check")
    raw = sm.message_stream(spark, "text", path=topic(spark, sf), maxFilesPerTrigger=1)
    sm.land_messages(sm.envelope(raw, F.lit("2025-01-01T00:00:00")), out, check).awaitTermination()
    return spark.read.schema("value string, ts string").json(out)


@plan("stream_two_hops", "X3 P10 S13", f"WITH {CLEANED_SQL} SELECT id, source, text, length(text) AS text_length FROM cleaned")
def stream_two_hops(spark, sf):
    raw_path, clean_path, check = work_dir(spark, "hop1"), work_dir(spark, "hop2"), work_dir(spark, "hops-check")
    raw = sm.message_stream(spark, "text", path=topic(spark, sf), maxFilesPerTrigger=2)
    sm.two_hop(spark, raw, raw_path, clean_path, check, F.lit("2025-01-01T00:00:00"))
    return spark.read.schema("id string, source string, text string, text_length bigint").json(clean_path)


@plan("stream_progress", "X4", "SELECT count(*) AS input_rows FROM events")
def stream_progress(spark, sf):
    out, check, log = (work_dir(spark, f"progress-{x}") for x in ("out", "check", "log"))
    raw = sm.message_stream(spark, "text", path=topic(spark, sf), maxFilesPerTrigger=3)
    sm.start_idempotent_sink(raw, out, check, log).awaitTermination()
    return spark.read.parquet(log).agg(F.sum("input_rows").alias("input_rows"))


@plan(
    "stream_without_replays",
    "S13 X1 TR23",
    """SELECT 'events' AS topic, (event_id % 3)::INT AS partition, event_id AS offset, event_type AS value FROM events""",
)
def stream_without_replays(spark, sf):
    """Every message is landed twice, in the same and in another batch; the query is stopped and started again in between."""
    landed, out, check = work_dir(spark, "replays"), work_dir(spark, "replays-out"), work_dir(spark, "replays-check")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.lit("events").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.col("event_type").alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )
    for part in range(3):
        some = rows.where(F.col("partition") != part)  # each message is in two of the three batches
        some.unionByName(some.where("offset % 7 = 0")).write.mode("append").json(landed)
        stream = spark.readStream.schema(sm.ENVELOPE_SCHEMA).json(landed)
        sm.start_sink(sm.without_replays(stream, "60 days"), out, check).awaitTermination()
    return spark.read.parquet(out).select("topic", "partition", "offset", "value")


@plan("stream_progress_of_all", "X4", "SELECT count(*) AS input_rows, count(*) AS landed_rows FROM events")
def stream_progress_of_all(spark, sf):
    """The rows that a listener was told of by all batches of a plain file sink, and those that arrived."""
    import time

    out, check, path = (work_dir(spark, f"listened-{x}") for x in ("out", "check", "log"))
    log = sm.ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        raw = sm.message_stream(spark, "text", path=topic(spark, sf), maxFilesPerTrigger=1)
        query = sm.start_sink(raw, out, check)
        query.awaitTermination()
        for _ in range(300):  # listeners are told of the end a little later
            if path_exists(spark, f"{path}/_SUCCESS"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
        log.flush()
    landed = spark.read.schema("value string").parquet(out)
    seen = log.read().where(F.col("query_id") == str(query.id))
    return seen.agg(F.sum("input_rows").alias("input_rows")).crossJoin(landed.agg(F.count("*").alias("landed_rows")))
