"""Sinks: tables, JSON lines, previews, promotion, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.functions import patterns as P


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, fmt: str = "parquet"
) -> None:
    """Write parquet, or another table format; overwriting a lake table may replace its schema."""
    writer = df.write.mode(mode).format(fmt)
    if fmt != "parquet" and mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_landed(df: DataFrame, path: str, landing_date: Column | None = None) -> None:
    """Append under the landing date ``dt``."""
    dt = landing_date if landing_date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    write_table(df.withColumn("dt", dt), path, "append", ["dt"])


def overwrite_by_event_date(df: DataFrame, ts: str, path: str) -> None:
    """Overwrite, partitioned by the date of the event."""
    write_table(df.withColumn("dt", F.to_date(ts)), path, "overwrite", ["dt"])


def write_preview_csv(df: DataFrame, path: str, order_by: list[str], rows: int = 20) -> None:
    """One CSV file with a header and the first rows in key order: a preview for reading."""
    df.orderBy(*order_by).limit(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_both(df: DataFrame, first: str, second: str, fmt: str = "parquet") -> None:
    """One frame to two places: the second copy is read from the first, not computed again."""
    write_table(df, first, fmt=fmt)
    write_table(df.sparkSession.read.format(fmt).load(first), second, fmt=fmt)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def promote(good: DataFrame, bad: DataFrame, canonical: str, archive: str, batch_id: str, publish: str | None = None,
            publish_fmt: str = "delta") -> None:
    """Good rows replace the canonical table, bad rows are archived under the batch."""
    write_table(good, canonical)
    write_table(bad, f"{archive.rstrip('/')}/bad_{batch_id}")
    if publish:
        write_table(good.sparkSession.read.parquet(canonical), publish, fmt=publish_fmt)


def manifest_frame(
    spark: SparkSession, table_path: str, build_id: str, built_at: str, source_hash: str, source_path: str = ""
) -> DataFrame:
    """One row describing a built evidence table."""
    rows = spark.read.parquet(table_path).agg(F.count("*").alias("row_count"))
    return rows.select(
        F.lit(build_id).alias("build_id"),
        F.lit(built_at).alias("built_at"),
        F.lit(source_path).alias("source_xml_path"),
        F.lit(source_hash).alias("source_xml_hash"),
        "row_count",
        F.lit("v2").alias("schema_version"),
        F.lit("raw_drugbank_only").alias("evidence_basis"),
        F.array(*[F.lit(f) for f in P.EVIDENCE_FIELDS]).alias("fields_in_chunk_basis"),
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The one-row manifest as a JSON file."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def register_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> None:
    """A catalog table over stored files."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING {fmt} LOCATION '{path}'")
