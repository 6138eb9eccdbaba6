"""Joins with a table of unique keys that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.session import broadcast_if_small, written_once

HOT_ROWS = 4096


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", purpose: str = "hot") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``on``; both should be stored.

    A small table is broadcast. Otherwise the keys that more than ``HOT_ROWS`` rows share are
    counted; there is at most one for so many rows. Their part of the table is broadcast if its
    bytes are few, the other keys are joined by a shuffle, in which none of them weighs much.
    """
    small = broadcast_if_small(table, 200_000, 16 << 20)
    if small is not table:
        return rows.join(small, on, how)
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS)
    hot = written_once(counts.drop("__n").join(table, on), purpose)
    keys = broadcast_if_small(hot.select(*on))
    heavy = rows.join(keys, on, "left_semi").join(broadcast_if_small(hot), on, how)
    return heavy.unionByName(rows.join(keys, on, "left_anti").join(table, on, how))
