"""Phrase collocations by Toivonen's mining: a sample proposes phrases, full passes count them exactly.

1. A sample of the documents is mined level by level, with a threshold lowered below its
   share, which gives the proposed phrases.
2. A full pass counts each phrase that is proposed or in the negative border: whose words but
   the last, and whose words but the first, are proposed. The border is never listed; a
   phrase is in it by that test, where it occurs. Every single word is in it. It counts twice: by short
   keys, which leaves out what cannot be frequent, and what is left by its text, exactly.
3. A phrase of the border that turns out frequent is a failure. While failures are more than
   the proposed phrases, they join these, and a further pass counts what has become border by
   them. Otherwise one last pass counts every phrase that was not counted and none of whose
   parts was counted and found rare, however much longer than a failure it is.
   What was counted is then all that is frequent, since all parts of a frequent phrase are.

Proposed phrases go to the tasks as a set of bits of bounded size. Two phrases may share
bits; then more is counted than needed, and the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewell.llm.hot import looked_up
from sievewell.llm.texts import mixed, ranges, slices, span_hashes, utf8, word_bounds
from sievewell.session import written_once

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_MULT2 = _U(0xD1342543DE82EF95)
_BREAKS = list(b".,;:!?\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[_BREAKS] = True
_WORD = np.ones(256, bool)
_WORD[[*_BREAKS, 9, 32]] = False
LEAST_BITS, MOST_BITS = 16, 28
_SHORT = _U((1 << 48) - 1)
PILE = 1 << 20  # keys that a task adds up before they are sent
COUNTS = "lang string, phrase string, words int, key long, n long"


def place_bits(key: Column, bits: int) -> Column:
    """The two places of a key in a set of 2 ** ``bits`` bits."""
    mask = F.lit((1 << bits) - 1)
    return F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))


class KeySet:
    """A set of keys as bits; of keys that are not in it, some are said to be."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.mask, self.data = bits, _U((1 << bits) - 1), data

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in (keys & self.mask, (keys >> _U(32)) & self.mask):
            at = place.astype(np.int64)
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
        return found


def key_set(keys: DataFrame, bits: int | None = None, each: int = 16) -> KeySet:
    """The column ``key`` as bits: 16 for each key, but at most 2 ** 28 in all (32 MB), or the given number.

    Spark sets the bits in blocks of 4 KB; only those come to the driver. Sets of one number of bits
    grow with their keys: what a set holds, falsely or not, is held with more keys too.
    """
    bits = bits or min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(each * max(1, keys.count())))))
    places = keys.select(F.explode(place_bits(F.col("key"), bits)).alias("at")).select((F.col("at") + 1).alias("at"))
    blocks = places.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("set"))
    data = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for row in blocks.toLocalIterator():
        first = (row["block"] - 1) * 4096
        data[first : first + len(row["set"])] = np.frombuffer(bytes(row["set"]), np.uint8)
    return KeySet(bits, data)


class Words:
    """The words of a batch of texts, one after the other, with the pieces that they lie in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        lined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        # two joined with a line end between: text, line end, nothing; the text ends with a break, as a piece does
        data, bounds = utf8(lined)
        data = _LOWER[data]
        starts, ends = word_bounds(data, bounds, _WORD)
        piece = np.cumsum(_BREAK[data])
        self.piece = piece[starts] if len(starts) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(bounds, starts, side="right") - 1
        keep = _WORD[data]
        keep[ends] = True  # one byte after each word
        data[ends] = 32
        self.data = data[keep]
        sizes = ends - starts
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else starts
        self.ends = self.starts + sizes
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[self.doc] if len(starts) else np.zeros(0, np.int64)
        names = pa.array([x or "" for x in self.langs], pa.string())
        name_data, name_bounds = utf8(names)
        lang_key = np.array([span_hashes(name_data[a:b], np.array([0]), np.array([b - a]))[0] if b > a else 0 for a, b in zip(name_bounds[:-1], name_bounds[1:], strict=True)], np.uint64)
        words = span_hashes(data, starts, ends)
        if len(words):
            words = mixed(words * _MULT + lang_key[self.lang])
        self.one = words
        self.two = mixed(words * _MULT2)
        self._sums, self._keys = [words], [mixed(words + _U(1))]  # by size, less one

    def keys(self, size: int) -> np.ndarray:
        """The key of the phrase of ``size`` words that begins at each word, while there are so many."""
        while len(self._keys) < size:
            n = len(self._keys)
            self._sums.append(self._sums[-1][:-1] * _MULT + self.one[n:])
            self._keys.append(mixed(self._sums[-1] + _U(n + 1)))
        return self._keys[size - 1]

    def second_keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Other keys of the phrases at some places."""
        if 4 * len(at) < len(self.two):
            out = self.two[at]
            for j in range(1, size):
                out = out * _MULT2 + self.two[at + j]
        else:
            n = len(self.two) - size + 1
            out = self.two[:n]
            for j in range(1, size):
                out = out * _MULT2 + self.two[j : n + j]
            out = out[at]
        return mixed(out + _U(size))

    def inside(self, size: int) -> np.ndarray:
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1 : size - 1 + n]

    def text(self, at: np.ndarray, size: int) -> pa.Array:
        first, last = self.starts[at], self.ends[at + size - 1]
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.data[ranges(first, last - first)])).cast(pa.string())


def _counted(words: Words, size: int, wanted: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase at the ``wanted`` places, and how often it stands there."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return at, at
    a, b = one[at], words.second_keys(at, size)
    order = np.argsort(a)
    new = a[order][1:] != a[order][:-1]
    if (~new & (b[order][1:] != b[order][:-1])).any():  # two phrases share the first of their keys
        order = np.lexsort((b, a))
        new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    heads = np.concatenate([[0], np.flatnonzero(new) + 1])
    return at[order[heads]], np.diff(np.append(heads, len(at)))


def _due(words: Words, sizes: list[int], now: KeySet | None, before: KeySet | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, keys, due) for the places of a batch: the key of the phrase that begins there, and whether it is due.

    Due are all single words, and longer phrases whose two parts that lack an end word are
    proposed ``now``, unless both were so ``before``, when single words are not due either.
    """
    for size in sizes:
        keys, due = words.keys(size), words.inside(size)
        if size == 1 and before is not None:
            continue
        if size > 1 and len(keys):
            parts = words.keys(size - 1)
            held = now.holds(parts)
            due = due & held[:-1] & held[1:]
            if before is not None:
                held = before.holds(parts)
                due = due & ~(held[:-1] & held[1:])
        yield size, keys, due


def _last_due(words: Words, longest: int, now: KeySet, known: KeySet) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``_due``, what the last pass counts: all that was not counted and of whose parts none was counted and is not ``known``.

    Counted was each single word, and each phrase whose two parts that lack an end word are proposed ``now``.
    """
    maybe = counted = np.ones(len(words.one), bool)
    for size in range(1, longest + 1):
        keys = words.keys(size)
        if size > 1:
            maybe = maybe[:-1] & maybe[1:] & words.inside(size)
            counted = counted[:-1] & counted[1:]
            yield size, keys, maybe & ~counted
        if size == longest or not len(keys):
            return
        at = np.flatnonzero(maybe & counted)
        maybe[at] = known.holds(keys[at])
        at = np.flatnonzero(maybe)  # whether a phrase is proposed matters where it may be frequent
        counted = np.zeros(len(keys), bool)
        counted[at] = now.holds(keys[at])


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Keys of several slices with the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(n[order], heads) if len(heads) else n
    return pa.record_batch([pa.array(keys[heads].view(np.int64)), pa.array(sums.astype(np.int64))], names=["key", "n"])


def frequent_keys(docs: DataFrame, sizes: list[int], least: int, proposed: KeySet | None) -> DataFrame:
    """(key) of 48 bits under which due phrases stand ``least`` times or more together.

    Phrases that share a key are counted as one, so none that is frequent is missed. Most phrases of the
    border are rare: they are shuffled as two numbers, and never as text.
    """
    now = docs.sparkSession.sparkContext.broadcast(proposed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in slices(batches, "text", 1 << 20):
            words = Words(piece.column("text"), piece.column("lang"))
            for _, keys, due in _due(words, sizes, now.value, None):
                held.append(np.unique(keys[due] & _SHORT, return_counts=True))
            if sum(len(some) for some, _ in held) > PILE:
                yield _added(held)
                held = []
        if held:
            yield _added(held)

    counts = docs.select("lang", "text").mapInArrow(count, "key long, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def count_phrases(
    docs: DataFrame, sizes: list[int], proposed: KeySet | None = None, before: KeySet | None = None, among: KeySet | None = None, known: KeySet | None = None
) -> DataFrame:
    """(lang, phrase, words, key, n) of the phrases of ``sizes`` words in (lang, text) that are due, see ``_due``, or with ``known`` ``_last_due``.

    With ``among``, only of those whose short key it holds. Rows without phrase give the number of words
    of a language, when single words are due. A phrase has several rows.
    """
    sc = docs.sparkSession.sparkContext
    now, old, wanted, sure = sc.broadcast(proposed), sc.broadcast(before), sc.broadcast(among), sc.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 1 << 20):
            words = Words(piece.column("text"), piece.column("lang"))
            if not len(words.one):
                continue
            if 1 in sizes and old.value is None and sure.value is None:
                number = np.bincount(words.lang, minlength=len(words.langs))
                none = [None] * len(number)
                yield pa.record_batch([pa.array(words.langs, pa.string()), pa.array(none, pa.string()), pa.array([0] * len(number), pa.int32()), pa.array(none, pa.int64()), pa.array(number, pa.int64())], names=["lang", "phrase", "words", "key", "n"])
            for size, keys, due in _due(words, sizes, now.value, old.value) if sure.value is None else _last_due(words, max(sizes), now.value, sure.value):
                if wanted.value is not None and len(keys):
                    due = due & wanted.value.holds(mixed(keys & _SHORT))
                at, n = _counted(words, size, due, keys)
                for some in range(0, len(at), 1 << 17):
                    i = at[some : some + (1 << 17)]
                    lang = pa.array(words.langs, pa.string()).take(pa.array(words.lang[i]))
                    yield pa.record_batch(
                        [lang, words.text(i, size), pa.array(np.full(len(i), size, np.int32)), pa.array(keys[i].view(np.int64)), pa.array(n[some : some + (1 << 17)].astype(np.int64))],
                        names=["lang", "phrase", "words", "key", "n"],
                    )

    return docs.select("lang", "text").mapInArrow(count, COUNTS)


def _summed(counts: DataFrame, least: int) -> DataFrame:
    """One row per (lang, phrase) that stands ``least`` times or more, and per lang."""
    total = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("words").alias("words"), F.max("key").alias("key"))
    return total.where((F.col("n") >= least) | F.col("phrase").isNull())


def proposed_phrases(docs: DataFrame, least: int, longest: int, share: int, slack: float) -> DataFrame | None:
    """Keys of the phrases that stand ``slack`` times their share of ``least`` in one of ``share`` documents."""
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("lang", "text")
    picked = written_once(picked, "phrase-sample")
    wanted = max(2, math.floor(slack * least / share))
    levels, known = None, None
    for size in range(1, longest):  # no phrase is longer than the longest, so none has it as a part
        found = written_once(_summed(count_phrases(picked, [size], known), wanted).where("phrase IS NOT NULL").select("key"), "phrase-level")
        levels = found if levels is None else levels.unionByName(found)
        if found.isEmpty():
            break
        known = key_set(found)
    return levels


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 10, slack: float = 0.4) -> tuple[DataFrame, DataFrame, int]:
    """(lang, phrase, words, n) of all phrases that stand ``least`` times, (lang, n) of all words, and the number of passes.

    ``share`` and ``slack`` steer the work alone: the sample is one document of ``share``, its
    threshold ``slack`` times that share of ``least``. The counts are exact whatever it proposes.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    levels = proposed_phrases(rows, least, longest, share, slack)
    now, before, found, totals, passes = key_set(levels), None, None, None, 0
    sizes = list(range(1, longest + 1))
    while True:
        passes += 1
        among = None
        if before is None:  # the first border is large, and nearly all of it is rare; later ones are small
            short = written_once(frequent_keys(rows, sizes, least, now), "phrase-keys")
            among = key_set(_spread_keys(short), each=64)
        counted = written_once(_summed(count_phrases(rows, sizes, now, before, among), least), "phrase-counts")
        totals = counted.where("phrase IS NULL").select("lang", "n") if totals is None else totals
        counted = counted.where("phrase IS NOT NULL")
        found = counted if found is None else found.unionByName(counted)
        failed = written_once(_not_in(counted.where(F.col("words") < longest), now), "phrase-failures")
        number = failed.count()
        if number and number <= levels.count():  # few: what they open is counted at once, not a length at a time
            passes += 1
            known = key_set(found.where(F.col("words") < longest), each=64)
            last = _summed(count_phrases(rows, sizes, now, known=known), least)
            found, number = found.unionByName(written_once(last, "phrase-counts")), 0
        if not number:
            return found.select("lang", "phrase", "words", "n"), totals, passes
        levels = levels.unionByName(failed)
        now, before = key_set(levels, now.bits), now  # as many bits, so that no phrase is taken out and counted again


def _spread_keys(keys: DataFrame) -> DataFrame:
    """Short keys as those that a key set looks up: with all their bits mixed."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(mixed(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))], names=["key"])

    return keys.mapInArrow(spread, "key long")


def _not_in(counted: DataFrame, proposed: KeySet) -> DataFrame:
    """Keys of the phrases that are not among the proposed: failures of the border."""
    held = counted.sparkSession.sparkContext.broadcast(proposed)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(~held.value.holds(keys.view(np.uint64))))

    return counted.select("key").mapInArrow(left, "key long")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, within: int = 100, best: int = 2000, share: int = 10, slack: float = 0.4
) -> DataFrame:
    """The ``best`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are put in small letters (A-Z only) and split at ``.,;:!?`` and line ends into pieces,
    pieces at blanks and tabs into words. A candidate is a phrase of 2 to ``longest`` words that
    stands ``least`` times or more (``a``) inside pieces of texts of its language, overlaps
    included. Cut after its first k words, its parts stand l and r times, of n words; its score
    is floor(1000 a n / (l r)) at the cut where that is least, the smallest such k among ties. A
    candidate is dropped if a longer candidate that holds it stands ``within`` percent as often.
    The rest is ranked by score, then ``a``, descending, then by the bytes of the phrase.

    A null lang is ``und``, and so one with texts that say ``und``; a null or empty text has no
    words; rows that repeat, and rows without id, count as often as they occur; other columns do
    not matter; a language without candidates has no row, an empty table none at all. Numbers
    are exact up to 38 digits, beyond which Spark raises an error instead of rounding.
    """
    phrases, totals, _ = frequent_phrases(docs, least, longest, share, slack)
    phrases = written_once(phrases, "phrases")
    word = F.split("phrase", " ")
    of = lambda first, n: F.array_join(F.slice(word, first, n), " ")
    candidates = phrases.where("words > 1")
    # what a longer phrase leaves when it loses an end word; what lies deeper in it stands between, and as often
    parts = candidates.where("words > 2").select("lang", "n", F.explode(F.array(of(F.lit(1), F.col("words") - 1), of(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("held") < within * F.col("n"), F.lit(True))).drop("held")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", of(F.lit(1), F.col("k")).alias("left"), of(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = written_once(cuts, "phrase-cuts")
    cuts = looked_up(cuts, phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"], "inner")
    cuts = looked_up(written_once(cuts, "phrase-cuts"), phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"], "inner")
    cuts = looked_up(written_once(cuts, "phrase-cuts"), totals, ["lang"], "inner")
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")
    least_cut = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = least_cut.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 100, longest: int = 5, within: int = 100, best: int = 2000) -> str:
    """The same in DuckDB's SQL: every phrase of every length is counted."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), counted AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
  FROM starts, range(1, {longest + 1}) AS sizes(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {least}
), kept AS (
  SELECT lang, phrase, m, f AS a FROM counted c WHERE m > 1 AND NOT EXISTS (
    SELECT 1 FROM counted o WHERE o.lang = c.lang AND o.m > c.m AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= {within} * c.f)
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
  FROM kept, range(1, {longest}) AS places(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = c.x JOIN counted r ON r.lang = c.lang AND r.phrase = c.y JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {best}
"""
