"""JSON message streams: sources, clean-up hops, sinks, replays, progress.

But for :func:`without_replays` the queries are stateless appends, so there is no watermark;
exactly-once comes from the checkpoint of the file sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sievewell.operators.standardize import clean_messages

# Fields of the event and of the chat messages.
EVENT_SCHEMA = "id BIGINT, ts STRING, source STRING, text STRING, amount DOUBLE"
CHAT_SCHEMA = "question STRING, user_id STRING, ts STRING"


def message_stream(spark: SparkSession, fmt: str, starting: str = "earliest", **options) -> DataFrame:
    """Raw messages with a string ``value``: a broker topic, or a folder of text files."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", starting)
    path = options.pop("path", None)
    reader = reader.options(**options)
    raw = reader.load(path) if path else reader.load()
    others = [c for c in ("topic", "partition", "offset", "timestamp") if c in raw.columns]
    return raw.select(F.col("value").cast("string").alias("value"), *others)


def json_stream(spark: SparkSession, fmt: str, schema: str, starting: str = "earliest", **options) -> DataFrame:
    """Typed columns of the JSON messages; a message that cannot be read gives nulls."""
    raw = message_stream(spark, fmt, starting, **options)
    return raw.select(F.from_json("value", schema).alias("j")).select("j.*")


def envelope(raw: DataFrame, ts: Column) -> DataFrame:
    """Landing envelope: topic, partition, offset, value, time; a folder has no offsets."""
    have = set(raw.columns)
    part = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    return raw.select(
        part("topic", "string").alias("topic"),
        part("partition", "int").alias("partition"),
        part("offset", "bigint").alias("offset"),
        "value",
        ts.cast("string").alias("ts"),
    )


ENVELOPE_SCHEMA = "topic STRING, partition INT, offset BIGINT, value STRING, ts STRING"


def without_replays(envelopes: DataFrame, limit: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each message (topic, partition, offset) of a stream of envelopes once, whatever is sent or landed again.

    The offsets seen are kept as keyed state in the checkpoint. ``limit`` bounds it: an offset is
    forgotten when the latest message time is that much later, so replays within ``limit`` are found
    for certain, and the state holds the offsets of that time, not of the whole topic. A message that comes
    later than ``limit`` behind the latest is dropped as too late to judge. A message without offset or
    time cannot be told from a replay and has no limit; it is left out: send such to another sink.
    """
    timed = envelopes.withColumn("_event_time", F.try_to_timestamp(F.col(ts))).where("_event_time IS NOT NULL AND offset IS NOT NULL")
    keyed = timed.withColumns({"_topic": F.coalesce("topic", F.lit("")), "_partition": F.coalesce("partition", F.lit(-1))})
    once = keyed.withWatermark("_event_time", limit).dropDuplicatesWithinWatermark(["_topic", "_partition", "offset"])
    return once.drop("_event_time", "_topic", "_partition")


def start_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
    once: bool = True,
) -> StreamingQuery:
    """Append to files or a lake table. ``once`` works off what is there and ends."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def with_landing_date(df: DataFrame, landing_date: Column | None = None) -> DataFrame:
    dt = landing_date if landing_date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    return df.withColumn("dt", dt)


def start_idempotent_sink(df: DataFrame, path: str, checkpoint: str, progress: str | None = None) -> StreamingQuery:
    """Each micro-batch replaces its own folder, so a repeated batch adds nothing.

    For table formats without a transactional streaming sink. Folders carry the id that the
    checkpoint gives the query, so a new checkpoint, which counts batches from 0 again,
    replaces nothing of an older one. With ``progress``, a row (batch_id, input_rows) of every
    batch is kept there, however many there are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        target = f"{path}/run={run}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if progress:
            rows = spark.read.schema(batch.schema).parquet(target).agg(F.lit(batch_id).cast("bigint").alias("batch_id"), F.count("*").alias("input_rows"))
            rows.write.mode("overwrite").parquet(f"{progress}/run={run}/of={batch_id}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def land_messages(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Land raw messages as JSON lines. Bound a round by the source's own option
    (``maxOffsetsPerTrigger`` of a topic, ``maxFilesPerTrigger`` of a folder)."""
    return start_sink(raw, path, checkpoint, fmt="json")


def two_hop(spark: SparkSession, raw: DataFrame, raw_path: str, clean_path: str, checkpoints: str, processed_at: Column) -> None:
    """Raw messages to JSON lines, and from those files to cleaned JSON lines, each with its checkpoint."""
    land_messages(raw.select("value"), raw_path, f"{checkpoints}/raw").awaitTermination()
    landed = spark.readStream.schema("value STRING").json(raw_path)
    cleaned = clean_messages(landed, "value", processed_at)
    start_sink(cleaned, clean_path, f"{checkpoints}/clean", fmt="json").awaitTermination()


def progress_rows(query: StreamingQuery) -> DataFrame:
    """(batch_id, input_rows) of the micro-batches that the query still remembers, by default the last 100.

    For all of them give :func:`start_idempotent_sink` a ``progress`` folder.
    """
    spark = SparkSession.active()
    rows = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id bigint, input_rows bigint")


def status_row(query: StreamingQuery) -> DataFrame:
    """One row: is the query active, its last message, how many recent batches had input."""
    recent = sum(1 for p in query.recentProgress if p["numInputRows"] > 0)
    return SparkSession.active().createDataFrame(
        [(query.isActive, query.status["message"], recent)], "active boolean, message string, recent_batches int"
    )


PROGRESS_SCHEMA = "query_id string, run_id string, name string, batch_id bigint, input_rows bigint, trigger_ms bigint, state_rows bigint"


class ProgressLog(StreamingQueryListener):
    """Keeps a row of every micro-batch of every query of the session in a table, whatever their sinks.

    Rows are gathered and written below ``path`` when there are ``flush_rows`` of them, and when a query
    ends, by the thread that Spark tells listeners with; queries do not wait for it. ``read`` gives the table,
    with one row for a batch even if its progress was told twice. Start it with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 500):
        super().__init__()
        self.spark, self.path, self.flush_rows = spark, path, flush_rows
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = sum(op.numRowsTotal for op in p.stateOperators)
        took = dict(p.durationMs).get("triggerExecution")
        self.rows.append((str(p.id), str(p.runId), p.name, p.batchId, p.numInputRows, took, state))
        if len(self.rows) >= self.flush_rows:
            self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS_SCHEMA).parquet(self.path).dropDuplicates(["query_id", "run_id", "batch_id"])
