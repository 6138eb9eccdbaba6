"""Quality of documents by the votes of their nearest labelled neighbours in a latent-semantic space.

A document's terms are runs of three character kinds (letter, capital, digit, blank, line
end, each punctuation mark), kinds at word ends, repeated words, and frequent words; all are
hashed into a fixed number of dimensions, damped and weighted by rarity. A truncated
singular value decomposition of a bounded sample of labelled rows gives the latent space.
The sample's vectors are broadcast, every document is compared with all of them in blocks
of exact cosines, and the labels of the closest vote with their likeness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.texts import lower_words, mixed, slices, utf8
from sievewell.session import written_once

DIMENSIONS = 2048
TEST_FOLD = "pmod(crc32(cast(doc_id AS string)), 3)"
# kinds: 0 small letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 letter of another script, then one for each mark
_KIND = np.full(256, 5, np.int64)
_KIND[list(range(97, 123))] = 0
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[[32, 9]] = 3
_KIND[[10, 11, 12, 13]] = 4
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND[_MARKS] = np.arange(6, 6 + len(_MARKS))
_KINDS = 6 + len(_MARKS)


def _counts(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    place = (mixed(keys.astype(np.uint64)) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.bincount(owner * DIMENSIONS + place, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


_TRIPLE_PLACE: list[np.ndarray] = []


def _triple_places() -> np.ndarray:
    if not _TRIPLE_PLACE:
        _TRIPLE_PLACE.append((mixed(np.arange(_KINDS**3, dtype=np.uint64)) % np.uint64(DIMENSIONS)).astype(np.int64))
    return _TRIPLE_PLACE[0]


def term_counts(col: pa.Array) -> np.ndarray:
    """Counts of hashed terms of each text, damped by the logarithm and scaled to the length of the text."""
    n = len(col)
    data, bounds = utf8(col)
    out = np.zeros((n, DIMENSIONS))
    kind = _KIND[data]
    if len(kind) >= 3:
        triple = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]
        inside = np.ones(len(triple), bool)
        for cut in bounds[1:-1]:
            inside[max(cut - 2, 0) : cut] = False
        owner = np.searchsorted(bounds, np.arange(len(triple)), "right") - 1
        out += np.bincount(owner[inside] * DIMENSIONS + _triple_places()[triple[inside]], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    words, to = lower_words(col)
    if len(words):
        owner = np.repeat(np.arange(n), np.diff(to))
        again = np.zeros(len(words), np.uint64)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        out += _counts(again + np.uint64(1 << 40), owner, n)
        out += _counts(words, owner, n)
        # a word that the same text has had before
        order = np.lexsort((words, owner))
        seen = np.zeros(len(words), np.uint64)
        seen[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        out += 2 * _counts(seen + np.uint64(1 << 41), owner, n)
    total = out.sum(1, keepdims=True)
    return np.log1p(out * (1000 / np.maximum(total, 1)))


@dataclass(frozen=True)
class Neighbours:
    """Term weights, the latent base, and the labelled vectors with their labels and the weight of each label."""

    rarity: np.ndarray
    base: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.rarity) @ self.base
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def votes(self, counts: np.ndarray, k: int, block: int = 256) -> np.ndarray:
        """The share of likeness that the ``k`` nearest with label 1 have; the prior where nothing is alike.

        Neighbours as near as the k-th all vote, so ties do not depend on the order.
        """
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(k, len(self.labels))
        for at in range(0, len(counts), block):
            part = counts[at : at + block]
            like = np.round(self.project(part) @ self.vectors.T, 12)
            edge = -np.partition(-like, k - 1, axis=1)[:, k - 1 : k]
            weight = np.where(like >= edge, np.clip(like, 0, None) ** 4, 0.0)
            total = weight.sum(1)
            some = (total > 1e-12) & (part.sum(1) > 0)
            out[at : at + block][some] = (weight @ self.labels)[some] / total[some]
        return out


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, label): distinct labelled texts of the training fold, at most ``most`` of each label, by the order of a hash."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where(f"label IS NOT NULL AND {TEST_FOLD.replace('doc_id', 'id')} <> 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rows.select("doc_id", F.xxhash64("text").alias("h")).join(marks, F.col("doc_id") == F.col("id")).groupBy("h").agg(F.avg("label").alias("p"), F.min("doc_id").alias("doc_id"))
    chosen = chosen.select("doc_id", (F.col("p") > 0.5).cast("int").alias("label"), F.xxhash64("h").alias("place"))
    some = [chosen.where(F.col("label") == k).orderBy("place", "doc_id").limit(most) for k in (0, 1)]
    some = written_once(some[0].unionByName(some[1]).select(F.col("doc_id").alias("id"), "label"), "quality-sample")
    # of several texts under one id the one of the smallest hash stays
    texts = rows.join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("doc_id", "label", "text").groupBy("doc_id", "label")
    return texts.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("doc_id", "r.text", "label")


def fitted(docs: DataFrame, labels: DataFrame, most: int = 1500, rank: int = 48) -> Neighbours:
    """The latent space of at most ``most`` labelled texts of each label, whose term counts (16 KB each) come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 1 << 20):
            x = term_counts(piece.column("text")).astype(np.float32)
            yield pa.record_batch([piece.column("doc_id"), piece.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "counts"])

    rows = training_rows(docs, labels, most).mapInArrow(count, "doc_id long, label int, counts binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return Neighbours(np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(bytes(c), np.float32) for c in rows["counts"]]).astype(float)
    label = rows["label"].to_numpy().astype(float)
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1
    _, _, v = np.linalg.svd(x * rarity, full_matrices=False)
    made = Neighbours(rarity, v[:rank].T.copy(), np.zeros((0, 1)), label, float(label.mean()))
    return Neighbours(rarity, made.base, made.project(x), label, float(label.mean()))


def scored(docs: DataFrame, model: Neighbours, k: int = 15, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The whole text is scored. A text without terms (null, empty, or under three bytes
    without a word) gets the share of label 1 in the sample, as does every text if there
    are no labelled rows (0.5). A null id is not held out. Rows that repeat give one row
    each; an empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 1 << 19):
            votes = shared.value.votes(term_counts(piece.column("text")), k)
            yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(votes, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(TEST_FOLD) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
