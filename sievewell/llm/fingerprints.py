"""SimHash fingerprints of documents and the search for near ones by permuted block tables.

Terms are pairs of neighbouring words, weighted by the length of the words, so that pairs
of common short words say little. Each term's hash votes with its weight on every bit of
the fingerprint; the sign of the sum is the bit. Two fingerprints that differ in at most
``radius`` bits agree in one of ``radius + 1`` blocks, so one table for each block, led by
that block, finds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewell.llm.buckets import linked
from sievewell.llm.texts import mixed, slices, span_hashes, utf8, word_bounds
from sievewell.session import written_once

BITS = 256
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_LANES = mixed(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _MULT)


def fingerprints(col: pa.Array) -> np.ndarray:
    """The fingerprints of texts, 32 bytes each. A text without words votes for nothing: zero."""
    data, bounds = utf8(pc.utf8_lower(col))
    starts, ends = word_bounds(data, bounds)
    words, to = span_hashes(data, starts, ends), np.searchsorted(starts, bounds)
    sizes = ends - starts
    # pairs of neighbours, a text's first word also by itself
    before = np.zeros(len(words), np.uint64)
    before[1:] = words[:-1]
    weight = sizes.astype(np.float32)
    weight[1:] += sizes[:-1]
    first = to[:-1][np.diff(to) > 0]
    before[first] = 0
    weight[first] = sizes[first]
    weight = np.minimum(1 + np.floor(weight / 4), 8).astype(np.float32)
    terms = mixed(before * _MULT + words)
    out = np.zeros((len(col), BITS // 8), np.uint8)
    for i in np.flatnonzero(np.diff(to)):
        votes = np.zeros(BITS, np.float32)
        for at in range(to[i], to[i + 1], 1 << 14):
            part = slice(at, min(at + (1 << 14), to[i + 1]))
            lanes = mixed(terms[part, None] ^ _LANES[None, :]).view(np.uint8)
            votes += weight[part] @ np.unpackbits(lanes, axis=1).astype(np.float32)
            votes -= weight[part].sum() / 2
        out[i] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits stands for, 0 at least; 1 for equal fingerprints."""
    apart = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.clip(np.cos(np.pi * apart / BITS), 0.0, 1.0)


def block_keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """The value of each of the ``radius + 1`` blocks of every fingerprint, as 8-byte numbers."""
    bits = np.unpackbits(prints, axis=1)
    cuts = np.linspace(0, BITS, radius + 2).astype(int)
    out = np.zeros((len(prints), radius + 1), np.int64)
    for k in range(radius + 1):
        lead = np.packbits(bits[:, cuts[k] : cuts[k + 1]], axis=1)
        for column in lead.T:
            out[:, k] = (mixed(out[:, k].view(np.uint64) * _MULT + column + _U(1))).view(np.int64) if lead.shape[1] > 7 else out[:, k] * 256 + column
    return out


def within(radius: int):
    def compare(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) for x in (left, right))
        apart = np.zeros((len(a), len(b)), np.int64)
        for k in range(a.shape[1]):
            apart += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
        return apart <= radius

    return compare


def near_fingerprints(prints: DataFrame, radius: int = 7) -> DataFrame:
    """(digest, item_id, n_links, group_id) of each distinct fingerprint of (doc_id, print).

    ``n_links`` counts the other documents whose fingerprints differ in ``radius`` bits at
    most, equal ones included; ``group_id`` is the smallest id that such links reach. All
    of them are found. Null fingerprints take no part.
    """
    if not 0 <= radius < BITS // 8:
        raise ValueError(f"radius must lie between 0 and {BITS // 8 - 1}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("digest").to_pylist()
            keys = block_keys(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), BITS // 8), radius) if raw else []
            yield pa.record_batch([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*batch.schema.names, "keys"])

    items = prints.where("print IS NOT NULL").groupBy(F.col("print").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("item_id"))
    items = items.withColumn("payload", F.col("digest")).mapInArrow(keyed, "digest binary, copies long, item_id long, payload binary, keys binary")
    return linked(written_once(items, "fingerprint-items"), within(radius))


def _ordered(docs: DataFrame, piece_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with the piece of the descending order of ids in which each row lies; rows without id come last, by hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    pieces = max(64, size // piece_bytes)
    bounds = rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / pieces for k in range(1, pieces)], 0.25 / pieces)
    bounds = np.unique(np.array(bounds, float))

    @F.pandas_udf("long")
    def piece(ids: pd.Series, ties: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy(float), "right")
        last = len(bounds) + 1 + ((2.0**63 - ties.to_numpy(float)) / 2.0**64 * pieces).astype(np.int64)
        return pd.Series(np.where(known, at, last))

    return rows.withColumn("piece", piece("doc_id", "tie")), pieces


def with_next(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``next_value``, that of the row that follows by (piece, doc_id descending, tie descending); after the last the first.

    Rows are ordered inside their pieces only; the first row of each piece is all that pieces tell each other.
    """
    order = (F.desc_nulls_last("doc_id"), F.desc("tie"))
    lead = rows.withColumn("inner_next", F.lead(value).over(W.partitionBy("piece").orderBy(*order)))
    heads = rows.groupBy("piece").agg(F.max_by(value, F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head"))
    heads = written_once(heads, "piece-heads")
    ring = W.orderBy("piece")
    firsts = heads.select("piece", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("outer_next"))
    out = lead.join(firsts, "piece")
    return out.withColumn("next_value", F.coalesce("inner_next", "outer_next")).drop("inner_next", "outer_next")


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", 1 << 20):
        a, b = fingerprints(piece.column("text")), fingerprints(piece.column("edited"))
        others = [n for n in piece.schema.names if n not in ("text", "edited")]
        yield pa.record_batch(
            [*(piece.column(n) for n in others), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()), pa.array(likeness(a, b))],
            names=[*others, "print", "edited_print", "near_edited"],
        )


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(map(bytes, s)), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(likeness(x, y))


def fingerprint_documents(docs: DataFrame, radius: int = 7, piece_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as
    many, or all, of the next document's, by descending id; after the last comes the
    first, and a lone document follows itself. Rows that share an id follow each other by
    a hash of their text, rows without id come last. A null text is empty; a text without
    words has the zero fingerprint. ``n_near`` counts the other documents whose
    fingerprints differ in at most ``radius`` of 256 bits. Other columns do not matter; an
    empty table gives no rows.
    """
    rows, _ = _ordered(docs, piece_bytes)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) AS int))"), F.substring(F.col("next_value"), F.lit(1), half))
    both = with_next(rows, "text").withColumn("edited", edited)
    both = both.select("piece", "doc_id", "tie", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    schema = "piece long, doc_id long, tie long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double"
    prints = written_once(both.mapInArrow(_printed, schema), "fingerprints")
    near = near_fingerprints(prints.select("doc_id", "print"), radius).select(F.col("digest").alias("print"), F.col("n_links").alias("n_near"))
    out = with_next(prints, "print").join(near, "print", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited", F.pandas_udf(_near, T.DoubleType())("print", "next_value").alias("near_next"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
