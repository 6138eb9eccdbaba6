"""Session set-up and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CLEARED_AT_EXIT: set[str] = set()
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def local_session(app_name: str = "sievewell", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_base(spark: SparkSession) -> str:
    """The session's own folder below the shared folder named by ``spark.checkpoint.dir``; deleted when the process ends.

    On a cluster that setting is required: a folder of the driver's machine is not the
    executors'. Only a session whose executors live in the driver's process, as in tests,
    is given a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sievewell-")
        spark.sparkContext.setCheckpointDir(base)
    if (app := spark.sparkContext.applicationId) not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(app)
        atexit.register(_clear_quietly, spark)
    return f"{base.rstrip('/')}/sievewell/{spark.sparkContext.applicationId}"


def _clear_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process
        clear_work(spark)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the session's own folder."""
    return f"{work_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete what this session has written to its own folder; frames that read it end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_base(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_once(df, purpose: str, compression: str = "snappy"):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a durable table, so a lost executor costs a re-read
    and not a recomputation, and consumers that read different columns prune.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df, path: str, key: str, order: str, parts: int, compression: str = "snappy"):
    """Write ``df`` as Parquet in ``parts`` buckets by ``key``, each in the order of ``order``, and open it.

    Joins and aggregations whose keys include ``key`` then need no shuffle. Rows are sorted here, by ``order`` alone: the writer's
    own sort takes the bucket first, and works out the hash of both keys at every comparison.
    """
    name, spark = _table_name(path), df.sparkSession
    dealt = df.repartition(parts, key).sortWithinPartitions(order)  # a task has one bucket
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(parts, key)
    writer = writer.option("path", path).option("compression", compression)
    held = spark.conf.get(_OPEN_FILES, "0")
    spark.conf.set(_OPEN_FILES, str(max(int(held), 2)))  # without open files for buckets the writer sorts by itself
    try:
        writer.saveAsTable(name)
    finally:
        spark.conf.set(_OPEN_FILES, held)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, key: str, order: str, parts: int):
    """A table that ``bucketed`` has written, in this session or another: files do not say how they are laid out."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {int(parts)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return "sievewell_" + hashlib.md5(path.encode()).hexdigest()


def spread(df, *keys):
    """Give a frame with few input partitions one per core before heavy row-wise work.

    For scans only: a table of many splits is left as it is, and asking a plan
    with joins for its partitions would run them.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


def _row_bytes(df) -> Column:
    """About the bytes of a row: texts by their length, other single values as 8, the rest as JSON."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts).cast("long")


def broadcast_if_small(df, max_rows: int = 500_000, max_bytes: int = 64 << 20):
    """Mark a frame for broadcast when its rows and their bytes are counted to be few.

    Counting is an aggregation like any other. A larger frame is returned as it is, and
    the join is planned as a shuffle. Store a frame first that is dear to compute.
    """
    row = df.agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= max_rows and (row["b"] or 0) <= max_bytes else df
