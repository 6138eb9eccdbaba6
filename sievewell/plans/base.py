"""The registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.session import spread

AREAS = [
    "sourcing",
    "standardizing",
    "profiling",
    "checking",
    "splitting",
    "texting",
    "balancing",
    "retrieving",
    "guarding",
    "enriching",
    "evaluating",
    "classifying",
    "streams",
]


@dataclass(frozen=True)
class Plan:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_PLANS: dict[str, Plan] = {}


def plan(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists inventory ids."""

    def register(fn):
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = Plan(name, covers, fn, sql)
        return fn

    return register


def plans() -> dict[str, Plan]:
    for area in AREAS:
        import_module(f"sievewell.plans.{area}")
    return dict(_PLANS)


def oracles() -> dict[str, str]:
    return {n: p.sql for n, p in plans().items() if p.sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data_version(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A digest of the files behind tables: their paths, times and sizes. New data under an old path has a new one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    rows = files.load([f"{sf_dir}/{n}.parquet" for n in names]).select("path", "modificationTime", "length")
    row = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['s']}"


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts get heavy row-wise work: one small file is spread over the cores."""
    return spread(table(spark, sf_dir, name))
