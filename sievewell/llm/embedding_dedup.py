"""Near-duplicate vectors: random-hyperplane hashing, exact cosines, connected components.

Equal vectors of one label are one item. The signs of an item's products with random
hyperplanes make its bucket in each of several tables; bits per table grow with the
number of vectors of a label, and the number of tables with the bits, so that a pair at
the threshold meets in some table with the wanted chance. Items that meet are compared
by their exact cosine in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.buckets import linked
from sievewell.session import written_once


def table_plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket and number of tables for ``n`` vectors that can meet."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, n))) + 3))
    meet = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _planes(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((count, dim))


def _item(vector) -> np.ndarray | None:
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    x = np.asarray(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _hasher(bits: int, tables: int, seed: int):
    powers = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                digests, payloads, keys = [], [], []
                for label, vector in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                    x = _item(vector) if label is not None else None
                    if x is None:
                        digests.append(None), payloads.append(None), keys.append(None)
                        continue
                    if len(x) not in planes:
                        planes[len(x)] = _planes(seed, len(x), bits * tables)
                    # scaled, so that neither products nor lengths overflow; + 0.0 makes -0.0 and 0.0 one value
                    scaled = x / np.abs(x).max()
                    side = (planes[len(x)] @ scaled > 0).reshape(tables, bits)
                    tag = int.from_bytes(hashlib.blake2b(f"{label}\0{len(x)}".encode(), digest_size=7).digest(), "big")
                    digests.append(hashlib.blake2b((x + 0.0).tobytes() + str(label).encode(), digest_size=16).digest())
                    payloads.append((scaled + 0.0).tobytes())
                    keys.append(((side @ powers) ^ np.int64(tag)).astype(np.int64).tobytes())
                yield pa.record_batch([batch.column("vec_id"), *(pa.array(c, pa.binary()) for c in (digests, payloads, keys))], names=["vec_id", "digest", "payload", "keys"])

    return sign


def cosines_reach(similarity: float):
    def compare(left: list[bytes], right: list[bytes]) -> np.ndarray:
        # a bucket can only by accident hold two lengths of vector; they are never alike
        sizes = np.array([len(x) for x in left])[:, None] == np.array([len(x) for x in right])[None, :]
        wide = max(map(len, (*left, *right))) // 8
        a, b = (np.zeros((len(s), wide)) for s in (left, right))
        for m, s in ((a, left), (b, right)):
            for k, x in enumerate(s):
                m[k, : len(x) // 8] = np.frombuffer(x)
        like = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
        return (like >= similarity) & sizes

    return compare


def near_duplicate_vectors(vectors: DataFrame, similarity: float = 0.98, recall: float = 0.9999, seed: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null, their lengths equal, and
    their cosine is ``similarity`` or more. Null, empty or zero vectors, and such with null
    or non-finite components, link with nothing; their component is their own id. A row
    without id counts as a link of others and has the component of its copies and
    neighbours, or null. Rows that repeat count as copies, also under one id. Other columns
    do not matter; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    most = rows.where("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    signed = written_once(rows.mapInArrow(_hasher(*table_plan(most, similarity, recall), seed), "vec_id long, digest binary, payload binary, keys binary"), "vector-keys")
    items = signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("item_id"), F.first("payload").alias("payload"), F.first("keys").alias("keys")
    )
    facts = linked(written_once(items, "vector-items"), cosines_reach(similarity))
    out = signed.select("vec_id", "digest").join(facts, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("group_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
