"""Connected components by alternating star operations over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.session import written_once


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every neighbour at the smallest node known around it, first
    for larger and then for smaller neighbours, so the edges become stars after a
    number of rounds that grows with the logarithm of the longest path. A round
    aggregates by node before it joins, and its edges are written to the shared
    folder, so a lost executor costs one round. Nothing comes to the driver but
    the count and the checksum that tell when nothing changes. An edge with a null
    end is no edge; a self-loop makes a component of one node.
    """
    whole = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    lone = whole.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    now = written_once(whole.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    lone = written_once(lone, "loops")
    seen = _checksum(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written_once(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written_once(moved.where("a <> b").distinct(), "edges")
        before, seen = seen, _checksum(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    known = found.unionByName(roots)
    return known.unionByName(lone.join(known.select("node"), "node", "left_anti"))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
