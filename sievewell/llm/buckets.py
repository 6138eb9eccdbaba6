"""Verified links between items that share a hash bucket in one of several tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.graph import components
from sievewell.session import written_once

Compare = Callable[[list[bytes], list[bytes]], np.ndarray]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (a, b) over ``n`` nodes."""
    root = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def _verifier(compare: Compare):
    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("digest", "ascending")]).combine_chunks()
        digest, copies, payload = table.column("digest").to_pylist(), table.column("copies").to_numpy(), table.column("payload").to_pylist()
        bucket, block, nth = (table.column(c).to_numpy() for c in ("bucket", "block", "nth"))
        keys = np.stack([np.frombuffer(x.as_py(), np.int64) for x in table.column("keys")])
        i, j = key[1].as_py(), key[2].as_py()
        found: dict[str, list] = {"digest": [], "links": [], "other": []}
        heads = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
            if b - a < 2:
                continue
            left = np.arange(a, b) if i == j else np.flatnonzero(block[a:b] == i) + a
            right = left if i == j else np.flatnonzero(block[a:b] == j) + a
            if not len(left) or not len(right):
                continue
            x, y = np.nonzero(compare([payload[k] for k in left], [payload[k] for k in right]))
            x, y = left[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            first = ~(keys[x, : nth[a]] == keys[y, : nth[a]]).any(1)  # a pair counts in the first table that both share
            x, y = x[first], y[first]
            if not len(x):
                continue
            count = np.zeros(b - a, np.int64)
            np.add.at(count, x - a, copies[y])
            np.add.at(count, y - a, copies[x])
            some = np.flatnonzero(count)
            found["digest"] += [digest[a + k] for k in some]
            found["links"] += count[some].tolist()
            found["other"] += [None] * len(some)
            for p, q in forest(b - a, x - a, y - a):
                found["digest"].append(digest[a + p])
                found["links"].append(0)
                found["other"].append(digest[a + q])
        return pa.table([pa.array(found["digest"], pa.binary()), pa.array(found["links"], pa.int64()), pa.array(found["other"], pa.binary())], names=list(found))

    return verify


def _compared(met: DataFrame, items: DataFrame, compare: Compare, block_rows: int) -> DataFrame:
    """Counts and forest edges of (digest, nth, bucket, n), the entries of buckets of ``n`` items."""
    lots = max(1, met.count() // 4096) * 2
    large = F.col("n") > block_rows
    cells = met.select(
        "digest", "nth", "bucket", F.when(large, F.ceil(F.col("n") / block_rows)).otherwise(1).cast("int").alias("blocks"),
        F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(lots))).alias("task"),
    )
    cells = cells.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    cells = cells.withColumn("e", F.explode(ends)).select("digest", "nth", "bucket", "block", "task", "e.i", "e.j")
    full = cells.join(items.select("digest", "copies", "payload", "keys"), "digest")
    return written_once(full.groupBy("task", "i", "j").applyInArrow(_verifier(compare), "digest binary, links long, other binary"), "bucket-links")


def linked(items: DataFrame, compare: Compare, block_rows: int = 1024) -> DataFrame:
    """One row per item: digest, item_id, n_links, group_id.

    ``items`` has one row per distinct ``digest`` (binary): ``copies``, the number of rows
    it stands for, ``item_id``, their smallest id, ``payload`` (binary) and ``keys``, its
    bucket in each table, packed as 8-byte numbers. Items are compared where they share a
    bucket; the links found make groups, and inside a group all pairs are compared, so a
    link is counted there even if no bucket has offered it. A bucket or group of more than
    ``block_rows`` items is cut into blocks, and each pair of blocks is a task, so no
    task grows with it. Tasks return counts and a spanning forest, never all pairs.
    """
    tables = F.expr("transform(sequence(0, length(keys) div 8 - 1), k -> named_struct('nth', k, 'bucket', xxhash64(k, substring(keys, 8 * k + 1, 8))))")
    entries = items.where("length(keys) >= 8").select("digest", F.explode(tables).alias("e")).select("digest", "e.nth", "e.bucket")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("of"), "n")
    met = written_once(entries.join(sizes, F.col("bucket") == F.col("of")).drop("of"), "bucket-entries")
    offered = _compared(met, items, compare, block_rows).where("other IS NOT NULL").select(F.col("digest").alias("a"), F.col("other").alias("b"))
    groups = written_once(components(offered).select(F.col("node").alias("digest"), "component"), "bucket-groups")
    facts = groups.join(items.select("digest", "item_id"), "digest").groupBy("component").agg(F.min("item_id").alias("group_id"), F.count("*").alias("n"))
    grouped = written_once(groups.join(facts, "component").select("digest", F.xxhash64("component").alias("bucket"), "n", "group_id"), "bucket-members")
    found = _compared(grouped.select("digest", F.lit(0).alias("nth"), "bucket", "n"), items, compare, block_rows)
    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    out = items.select("digest", "copies", "item_id").join(counts, "digest", "left").join(grouped.select("digest", "group_id"), "digest", "left")
    return out.select("digest", "item_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group_id", "item_id").alias("group_id"))
