"""Toxicity of documents: a weighted lexicon, matched after folding look-alike characters.

Texts are brought to lower case, stripped of accents, and look-alike letters of other
scripts, digits and signs that stand for letters become those letters. One automaton
finds all lexicon entries in one pass over the whole folded text; hits inside an
exception phrase do not count. What the hits weigh is set against the length of the text.

The lexicon has a fixed list of insults and what the labelled rows add: words and word
beginnings that occur in toxic rows so much more often than chance allows that, among
all terms tried, none would be expected to. Weights are log-odds of the training rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.texts import by_text, lower_words, mixed, shingles, slices, utf8, word_bounds
from sievewell.session import written_once

# Insults, and phrases in which they are none.
INSULTS = [
    "asshole", "bastard", "bitch", "cretin", "dickhead", "dimwit", "dumbass", "fuck", "halfwit", "idiot", "imbecile", "jackass",
    "loser", "moron", "nitwit", "pathetic", "scum", "scumbag", "shithead", "stupid", "worthless",
    "abschaum", "arschloch", "dummkopf", "schwachkopf", "trottel", "connard", "imbecile", "salaud", "gilipollas", "imbecil", "pendejo",
]
EXCEPTIONS = [
    "clown fish", "class clown", "scum line", "pond scum", "soap scum", "sore loser", "trash can", "trash bag", "trash bin", "worthless stock",
    "white trash bag", "stupid mistake", "pathetic fallacy", "disgusting weather",
]
# Signs that are read as letters, and letters of other scripts that look like Latin ones.
_SIGNS = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
}
_FOLD = str.maketrans(_SIGNS | _LOOKALIKES)
_MARKS = {c: None for c in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF)}

PREFIXES = range(4, 9)
TEST_FOLD = "pmod(crc32(cast(doc_id AS string)), 3)"


def folded(text: str) -> str:
    """The text as the lexicon sees it; its length can change. i, l and 1 are one letter, in the lexicon too."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    return text.translate(_FOLD)


# marks that stand for i inside a word; between words they are marks
_INSIDE = re.compile(r"(?<=\w)[!|](?=\w)")


@dataclass(frozen=True)
class Lexicon:
    """Whole words and word beginnings with their weights, exception phrases, and the calibration of scores."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    bias: float = -3.0
    gain: float = 2.0
    per_length: float = -0.1

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        terms = {(w, "word"): x for w, x in self.words.items()} | {(w, "stem"): x for w, x in self.stems.items()} | {(p, "except"): 0.0 for p in self.exceptions}
        by_text: dict[str, list] = {}
        for (term, kind), weight in terms.items():
            by_text.setdefault(folded(term), []).append((kind, weight))
        for term, meanings in by_text.items():
            found.add_word(term, (len(term), meanings))
        found.make_automaton()
        return found


def hits_weight(text: str, automaton: ahocorasick.Automaton) -> float:
    """The sum of the weights of the words hit, each occurrence by its heaviest entry, outside exception phrases.

    A text with ``!`` or ``|`` inside words is read in both ways, as marks and as i, and the heavier counts.
    """
    text = folded(text)
    weight = _hits(text, automaton)
    if _INSIDE.search(text):
        weight = max(weight, _hits(_INSIDE.sub("i", text), automaton))
    return weight


def _hits(text: str, automaton: ahocorasick.Automaton) -> float:
    n = len(text)
    hits: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (size, meanings) in automaton.iter(text):
        start = end - size + 1
        if start and text[start - 1].isalnum():
            continue
        closed = end + 1 == n or not text[end + 1].isalnum()
        for kind, weight in meanings:
            if kind == "except":
                if closed:
                    free.append((start, end))
            elif kind == "stem" or closed:
                old = hits.get(start)
                if old is None or weight > old[1]:
                    hits[start] = (end, weight)
    if not hits:
        return 0.0
    return sum(w for s, (e, w) in hits.items() if not any(a <= s and e <= b for a, b in free))


def _scores(lexicon: Lexicon, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 to 1: a logistic curve over the hits' weight and the length."""
    x = lexicon.bias + lexicon.gain * np.log1p(weight) + lexicon.per_length * np.log1p(words) * np.log1p(weight)
    return np.where(weight > 0, 1 / (1 + np.exp(-np.clip(x, -30, 30))), 1 / (1 + math.exp(-max(-30.0, min(lexicon.bias, 0.0)))))


def _counted(piece: pa.RecordBatch) -> np.ndarray:
    data, bounds = utf8(piece.column("text"))
    starts, _ = word_bounds(data, bounds)
    return np.diff(np.searchsorted(starts, bounds))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, label): distinct labelled texts of the training fold, at most ``most`` of each label, by the order of a hash.

    A text with contradicting labels counts as toxic if most of its rows say so.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where(f"label IS NOT NULL AND {TEST_FOLD.replace('doc_id', 'id')} <> 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    keyed = rows.withColumn("h", F.xxhash64("text")).select("doc_id", "h")
    chosen = keyed.join(marks, F.col("doc_id") == F.col("id")).groupBy("h").agg(F.avg("label").alias("p"), F.min("doc_id").alias("doc_id"))
    chosen = chosen.select("doc_id", (F.col("p") > 0.5).cast("int").alias("label"), F.xxhash64("h").alias("place"))
    some = [chosen.where(F.col("label") == k).orderBy("place", "doc_id").limit(most) for k in (0, 1)]
    some = written_once(some[0].unionByName(some[1]).select(F.col("doc_id").alias("id"), "label"), "toxic-sample")
    # of texts under one id, and of near copies, the one of the smallest hash stays, whatever the order of the rows
    texts = rows.join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("doc_id", "label", "text").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    sketches = [f"m{k}" for k in range(_SKETCHES)]
    sketched = texts.select("r.text", "label").mapInArrow(_sketch, "text string, label int, " + ", ".join(f"{m} long" for m in sketches))
    for m in sketches:  # copies of one text prove nothing more about its words than the text itself
        others = [c for c in sketches if c != m]
        sketched = sketched.groupBy("label", m).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", *others)).alias("r")).select("label", m, "r.text", *(f"r.{c}" for c in others))
    return sketched.select("text", "label")


_SKETCHES = 6


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minima of the hashed three-word shingles, which near-copies share."""
    for piece in slices(batches, "text"):
        sets, to = shingles(*lower_words(piece.column("text")), 3)
        least = [by_text(np.minimum, mixed(sets + np.uint64(k)), to, np.uint64(0)).view(np.int64) for k in range(_SKETCHES)]
        yield pa.record_batch([piece.column("text"), piece.column("label"), *(pa.array(x, pa.int64()) for x in least)], names=["text", "label", *(f"m{k}" for k in range(_SKETCHES))])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of either label hold each word ("=word") and word beginning."""
    counts = (Counter(), Counter())
    rows = [0, 0]
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = {w for w in "".join(c if c.isalnum() else " " for c in folded(text)).split() if len(w) <= 40}
            counts[label].update({f"={w}" for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k})
            rows[label] += 1
    if not sum(rows):
        return
    counts[0][""], counts[1][""] = rows
    # most words occur once; those in one row of this task are summed up with the others all the same
    names = sorted(set(counts[0]) | set(counts[1]))
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.record_batch([pa.array(part), pa.array([counts[0][w] for w in part], pa.int64()), pa.array([counts[1][w] for w in part], pa.int64())], names=["term", "clean", "toxic"])


def learned(docs: DataFrame, labels: DataFrame, most: int = 3000, entries: int = 2000) -> Lexicon:
    """The lexicon of the training fold: ``most`` rows of each label at most, and ``entries`` entries at most.

    A term enters if its occurrences are too lopsided to be chance among all terms tried
    (a binomial tail, with Bonferroni's correction). A longer beginning of the same words
    adds nothing and is left out. Without labelled rows the fixed list decides alone.
    """
    sample = written_once(training_rows(docs, labels, most), "toxic-texts")
    counts = written_once(sample.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-terms")
    whole = counts.where("term = ''").first()
    fixed = {folded(w): 3.0 for w in INSULTS}
    if whole is None or not whole["clean"] or not whole["toxic"]:
        return Lexicon(fixed, {})
    clean, toxic = whole["clean"], whole["toxic"]
    base = toxic / (clean + toxic)
    tried = counts.where("toxic > 1").count()
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(p / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    found = counts.where("term <> '' AND toxic > 1").withColumn("weight", odds).withColumn("gain", gain)
    found = found.where((F.col("gain") > math.log(max(2, tried)) + 1) & (p > max(0.8, base)) & (F.col("weight") > 1))
    rows = found.orderBy(F.desc("gain"), "term").limit(entries).collect()
    stems = {r["term"]: (r["weight"], r["toxic"], r["clean"]) for r in rows if not r["term"].startswith("=")}
    words = {r["term"][1:]: r["weight"] for r in rows if r["term"].startswith("=")}
    alone = {}  # the rows that the commonest whole word of each beginning accounts for
    for r in rows:
        if r["term"].startswith("="):
            for k in PREFIXES:
                alone[r["term"][1 : k + 1]] = max(alone.get(r["term"][1 : k + 1], 0), r["toxic"])
    stems = {s: x for s, x in stems.items() if alone.get(s, 0) < 0.8 * x[1]}
    kept = {}
    for term in sorted(stems, key=len):  # the shortest beginning that is as clean stands for all that begin with it
        shorter = [term[:k] for k in range(min(PREFIXES), len(term)) if term[:k] in kept]
        if not shorter or all(stems[s][2] > stems[term][2] + 0.02 * stems[term][1] for s in shorter):
            kept[term] = stems[term][0]
    words = {w: x for w, x in words.items() if not any(w[:k] in kept for k in PREFIXES)}
    lexicon = Lexicon(fixed | words, kept)
    return _calibrated(sample, lexicon)


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Newton's method on the bounded sample; a weak prior keeps the slope finite where the lexicon parts the labels."""

    def weigh(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            w = [hits_weight(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(w, pa.float64()), pa.array(_counted(batch), pa.int64()), batch.column("label")], names=["w", "n", "label"])

    rows = sample.mapInArrow(weigh, "w double, n long, label int").toPandas()
    hit, length, label = np.log1p(rows["w"].to_numpy()), np.log1p(rows["n"].to_numpy()), rows["label"].to_numpy()
    x = np.stack([np.ones(len(rows)), hit, hit * length], 1)
    start = np.array([-3.0, 3.0, 0.0])
    prior = np.diag([0.05, 0.05, 5.0])
    beta = start.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (label - p) - prior @ (beta - start))
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.words, lexicon.stems, lexicon.exceptions, *(float(b) for b in beta))


def _scorer(lexicon: Lexicon):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for piece in slices(batches, "text"):
            weight = np.array([hits_weight(t, automaton) for t in pc.fill_null(piece.column("text"), "").to_pylist()], float)
            others = [i for i, n in enumerate(piece.schema.names) if n != "text"]
            yield pa.record_batch([*(piece.column(i) for i in others), pa.array(_scores(lexicon, weight, _counted(piece)), pa.float64())], names=[*(piece.schema.names[i] for i in others), "score"])

    return score


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The whole text is scored; a null or empty text has no hits and the score that goes
    with none. A null id is not held out. Rows that repeat give one row each, equal texts
    equal scores; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(TEST_FOLD) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(lexicon), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    _score = _scorer(lexicon)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            batch = pa.record_batch([pa.array(series, pa.string())], names=["text"])
            yield pd.concat([b.column("score").to_pandas() for b in _score(iter([batch]))] or [pd.Series([], dtype=float)], ignore_index=True)

    return docs.where(score(F.col("text").cast("string")) < threshold)
