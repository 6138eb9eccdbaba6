"""Incremental pull of a table by a time column with a stored high-water mark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.sources.files import path_exists


def read_mark(spark: SparkSession, state_path: str):
    """The stored mark, or None before the first run."""
    if not path_exists(spark, state_path):
        return None
    return spark.read.parquet(state_path).agg(F.max("max_updated_at")).first()[0]


def write_mark(spark: SparkSession, state_path: str, mark, data_type: str = "timestamp") -> None:
    """Replace the stored mark; an empty batch (no new mark) keeps the old one."""
    if mark is None:
        return
    frame = spark.range(1).select(F.lit(mark).cast(data_type).alias("max_updated_at"))
    frame.write.mode("overwrite").parquet(state_path)


def read_jdbc(spark: SparkSession, url: str, table: str, fetch_size: int = 10_000, **options) -> DataFrame:
    """A database table; give partitionColumn, bounds and numPartitions to read it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    return reader.options(**options).load()


def incremental_load(source: DataFrame, ts_col: str, state_path: str) -> DataFrame:
    """Rows newer than the mark (strictly), or all rows before the first run.

    The condition is a plain filter, so the source gets it as a pushed predicate.
    """
    mark = read_mark(source.sparkSession, state_path)
    return source if mark is None else source.where(F.col(ts_col) > F.lit(mark))


def pull(source: DataFrame, ts_col: str, state_path: str, out_path: str, landing_date: Column | None = None) -> int:
    """Write the new rows under their batch and landing date, then move the mark; returns the row count.

    The batch is named by the mark it starts from, and replaces what an earlier run from
    the same mark has left: a run that ends between the rows and the mark is repeated
    without adding rows twice. The new mark and the count come from the rows as written,
    so the source is read once.
    """
    spark = source.sparkSession
    start = read_mark(spark, state_path)
    batch_name = "first" if start is None else re.sub(r"[^0-9A-Za-z]+", "-", str(start))
    batch = incremental_load(source, ts_col, state_path)
    landed = batch.withColumns(
        {
            "dt": landing_date if landing_date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd"),
            "updated_date": F.to_date(ts_col),
        }
    )
    observed, seen = _observe(landed, ts_col)
    observed.write.mode("overwrite").partitionBy("dt").parquet(f"{out_path}/batch={batch_name}")
    stats = seen.get
    write_mark(spark, state_path, stats["mark"], dict(source.dtypes)[ts_col])
    return stats["rows"]


def _observe(df: DataFrame, ts_col: str):
    from pyspark.sql import Observation

    seen = Observation("pull")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(ts_col).alias("mark")), seen
