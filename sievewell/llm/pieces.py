"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut where no piece can reach across: before blanks and between characters that no piece has side by side. All distinct words of all texts
are encoded by relational steps: substrings up to the longest piece are joined with the piece
table by equality; the pieces found are the edges of a word's lattice, edges are grouped, some
thousand words at a time, and a fold over a word's positions picks the path. Texts travel as
numbers of words in slices of a few MB; a slice's distinct words go to the lattice and their ids come
back to the slice, so words that a slice repeats are moved once.

The fold follows the model's kind. For a unigram model the path has the greatest sum of
scores (Viterbi). For a model of merges (BPE) it is the path on which every piece and every
pair of neighbours is what the merges make of them; each position has exactly one such
way in, and the path is the one the merges would take.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewell.llm.texts import by_text, kept_by, mixed, ranges, slices, span_hashes, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_U = np.uint64
_MULT = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
START, UNKNOWN = -1, -2
LONGEST_WORD = 512
SLICE_BYTES, WORDS_AT_ONCE = 24 << 20, 400_000
LOT_BYTES, LOTS_PER_TASK = 1 << 20, 8  # a lot has the distinct words of about so many bytes of text


@dataclass
class Pieces:
    """A piece table: text, score and id of every piece that can be written, byte pieces, the unknown id, and the model's kind."""

    texts: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: dict[int, int]
    unknown_id: int
    kind: str
    names: dict[int, str]
    longest: int = 1
    _rank: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self._rank = dict(zip(self.texts, self.scores, strict=True))
        self.longest = max(map(len, self.texts), default=1)

    @property
    def unknown_score(self) -> float:
        return min(self.scores, default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """What merging the best neighbours, the leftmost of equals first, makes of a text."""
        rank = self._rank
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self) -> list[bool]:
        """Whether the merges make each piece of its own text; all pieces of a unigram model count."""
        return [self.kind != "bpe" or self.merged(t) == [t] for t in self.texts]

    def neighbours(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]


def load_pieces(path: str = MODEL) -> Pieces:
    """The piece table of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        kind = "bpe" if _model_kind(f.read()) == 2 else "unigram"
    texts, ids, scores, bytes_, names = [], [], [], {}, {}
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        names[i] = name
        if model.is_byte(i):
            bytes_[int(name[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts.append(name)
            ids.append(i)
            scores.append(model.get_score(i))
    return Pieces(texts, ids, scores, bytes_, model.unk_id(), kind, names)


def _model_kind(raw: bytes) -> int:
    """The model type among the training settings (field 2, therein field 3); 1, unigram, if none is given."""

    def fields(data: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            tag = number()
            wire = tag & 7
            if wire == 0:
                yield tag >> 3, number()
            elif wire == 2:
                size = number()
                yield tag >> 3, data[at : at + size]
                at += size
            else:
                at += 8 if wire == 1 else 4

    return next((v for k, block in fields(raw) if k == 2 for j, v in fields(block) if j == 3), 1)


# --- the lattice as a relation -------------------------------------------------------------


def _lot(lots: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(lots)).cast("int")


def _edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(lot, word, start, size, id): the lattices of distinct (lot, word), which stay dealt by lot.

    Words of more than LONGEST_WORD characters have one row without an edge.
    """
    rows = [(t, i) for t, i, ok in zip(pieces.texts, pieces.ids, pieces.whole(), strict=True) if ok]
    table = F.broadcast(words.sparkSession.createDataFrame(rows, "piece string, id int"))  # the model's size bounds it
    n = F.char_length("word")
    starts = F.when(n <= LONGEST_WORD, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(-1)))
    spans = words.select("lot", "word", F.explode(starts).alias("start"))
    most = F.when(F.col("start") < 0, 1).otherwise(F.least(F.lit(pieces.longest), n - F.col("start")))
    spans = spans.select("lot", "word", "start", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    spans = spans.withColumn("piece", F.expr("CASE WHEN start >= 0 THEN substring(word, start + 1, size) END"))
    edges = spans.join(table, "piece", "left").where("id IS NOT NULL OR size = 1")
    return edges.select("lot", "word", "start", "size", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))


def _folded(lattice: Lattice, edges: pa.Table) -> tuple[pa.Array, pa.ListArray]:
    """The distinct words of a lot's edges, and the ids of each."""
    found = edges.column("word").combine_chunks().dictionary_encode()
    words = found.dictionary
    row, start, size, ids = (np.asarray(x, np.int64) for x in (found.indices, *(edges.column(c) for c in ("start", "size", "id"))))
    on = start >= 0
    flat, count = lattice.fold(row[on], start[on], size[on], ids[on], pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    odd = np.zeros(len(words), bool)
    odd[row[~on]] = True
    odd[np.repeat(np.arange(len(words)), count)[flat == UNKNOWN]] = True
    if odd.any():
        parts = np.split(flat, to[1:-1])
        for k in np.flatnonzero(odd).tolist():
            word = words[k].as_py()
            parts[k] = lattice.with_bytes(parts[k], word) if len(word) <= LONGEST_WORD else lattice.long(word)
        flat, to = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return words, pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _lattice(shared) -> Lattice:
    """A worker keeps the table, and the pairs it has worked out, for its next groups and tasks."""
    kept = kept_by("pieces")
    if kept.get("run") != shared.value[1]:
        kept |= {"run": shared.value[1], "lattice": Lattice(shared.value[0], {})}
    return kept["lattice"]


def encode_words(words: DataFrame, pieces: Pieces, lots: int = 64) -> DataFrame:
    """(word, ids) of every distinct word of (word), by relational steps.

    Words hold the sign of a blank, not the blank. Null and empty words have no row. ``lots`` is the number
    of groups of words that are folded together; a group's lattices fit a task's memory.
    """
    shared = words.sparkSession.sparkContext.broadcast((pieces, uuid.uuid4().hex))

    def fold(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("word", "ids"), _folded(_lattice(shared), table), strict=True)))

    dealt = words.where("word <> ''").select(_lot(lots).alias("lot"), "word").repartition(_tasks(lots), "lot")
    return _edges(dealt.distinct(), pieces).groupBy("lot").applyInArrow(fold, "word string, ids array<int>")


def _tasks(lots: int) -> int:
    return -(-lots // LOTS_PER_TASK)


# --- the fold, and the same steps with arrays alone, for long words and for trials -----------


class Lattice:
    """Array form of the piece table, of the words known beforehand, and of the pairs of pieces met so far."""

    def __init__(self, pieces: Pieces, known: dict[str, list[int]]):
        self.pieces = pieces
        ok = pieces.whole()
        texts = [t for t, k in zip(pieces.texts, ok, strict=True) if k]
        self.ids = np.array([i for i, k in zip(pieces.ids, ok, strict=True) if k], np.int64)
        self.scores = np.array([s for s, k in zip(pieces.scores, ok, strict=True) if k], float)
        self.text_of = dict(zip(self.ids.tolist(), texts, strict=True))
        self.score_of = np.full(max(self.ids, default=0) + 1, 0.0)
        self.score_of[self.ids] = self.scores
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        to = np.concatenate([[0], np.cumsum(sizes)])
        sums, inverse = _prefix(codes)
        self.mask = (1 << max(4, (4 * len(texts)).bit_length())) - 1
        hashes = (sums[to[1:]] - sums[to[:-1]]) * inverse[to[:-1]]
        self.slot_hash, self.slot_id, self.probes = self._slots(mixed(hashes))
        self.letters = np.unique(codes)
        bigrams = codes[:-1] << _U(32) | codes[1:]
        inside = np.ones(len(bigrams), bool)
        inside[to[1:-1] - 1] = False
        self.bigrams = np.unique(bigrams[inside])
        self.pair_code = np.zeros(1 << 20, np.int64)
        self.pair_ok = np.zeros(1 << 20, bool)
        names = sorted(known)
        raw = "".join(names).replace(SPACE, " ").encode()
        ends = np.cumsum([len(n.replace(SPACE, " ").encode()) for n in names]).astype(np.int64) if names else np.zeros(0, np.int64)
        data = np.frombuffer(raw, np.uint8)
        starts = np.concatenate([[0], ends[:-1]]) if names else ends
        h = span_hashes(data, starts, ends) if names else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.known_hash, self.known_bytes = h[order], [raw[starts[k] : ends[k]] for k in order]
        self.known_ids = [np.array(known[names[k]], np.int64) for k in order]

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        slot_hash, slot_id = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int64)
        most = 1
        for h, i in zip(hashes.tolist(), self.ids.tolist(), strict=True):
            at, n = h & self.mask, 1
            while slot_id[at] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            slot_hash[at], slot_id[at] = h, i
            most = max(most, n)
        return slot_hash, slot_id, most

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these hashes, -1 for none."""
        at = (hashes & _U(self.mask)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for _ in range(self.probes):
            ids = self.slot_id[at]
            hit = (ids >= 0) & (self.slot_hash[at] == hashes[rest])
            out[rest[hit]] = ids[hit]
            on = (ids >= 0) & ~hit
            if not on.any():
                break
            rest, at = rest[on], (at[on] + 1) & self.mask
        return out

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave these neighbours apart. Pairs are worked out once and kept while their place is free."""
        free = (left == START) | (left == UNKNOWN) | (right == UNKNOWN)
        code = (left << np.int64(32) | right) + 1
        at = (mixed(code.view(np.uint64)) & _U(len(self.pair_code) - 1)).astype(np.int64)
        out = np.where(free, True, self.pair_ok[at])
        odd = np.flatnonzero(~free & (self.pair_code[at] != code))
        if len(odd):
            codes, back = np.unique(code[odd], return_inverse=True)
            ok = np.array([self.pieces.neighbours(self.text_of[c >> 32], self.text_of[c & 0xFFFFFFFF]) for c in (codes - 1).tolist()], bool)
            out[odd] = ok[back]
            place = (mixed(codes.view(np.uint64)) & _U(len(self.pair_code) - 1)).astype(np.int64)
            # of pairs with one place the last stays; both arrays are written in the same order
            last = len(place) - 1 - np.unique(place[::-1], return_index=True)[1]
            self.pair_code[place[last]], self.pair_ok[place[last]] = codes[last], ok[last]
        return out

    def paths(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids in reverse and their number for the words in the rows of ``codes``, all of ``size`` characters."""
        n = len(codes)
        sums = np.zeros((n, size + 1), np.uint64)
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(size, _MULT)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[_U(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
        np.cumsum(mixed(codes) * powers[:-1], axis=1, out=sums[:, 1:])
        bpe = self.pieces.kind == "bpe"
        last = np.full((n, size + 1), START, np.int64)
        back = np.zeros((n, size + 1), np.int64)
        score = np.zeros((n, size + 1))
        rows = np.arange(n)
        for end in range(1, size + 1):
            best = np.full(n, -np.inf)
            done = np.zeros(n, bool)
            for start in range(max(0, end - self.pieces.longest), end):
                todo = rows if not bpe else rows[~done]
                if not len(todo):
                    break
                ids = self.find(mixed((sums[todo, end] - sums[todo, start]) * inverse[start]))
                if start == end - 1:
                    ids = np.where(ids < 0, UNKNOWN, ids)
                hit = ids != -1
                todo, ids = todo[hit], ids[hit]
                if not len(todo):
                    continue
                if bpe:
                    good = self.agree(last[todo, start], ids)
                    todo, ids = todo[good], ids[good]
                    done[todo] = True
                else:
                    total = score[todo, start] + np.where(ids == UNKNOWN, self.pieces.unknown_score, self.score_of[np.maximum(ids, 0)])
                    good = total > best[todo]
                    todo, ids = todo[good], ids[good]
                    best[todo] = total[good]
                last[todo, end], back[todo, end] = ids, start
            if bpe and not done.all():
                raise AssertionError("a position without a way in")
            score[:, end] = best
        out = np.zeros((n, size), np.int64)
        count = np.zeros(n, np.int64)
        at = np.full(n, size)
        for k in range(size):
            on = at > 0
            if not on.any():
                break
            out[on, k] = last[on, at[on]]
            count[on] += 1
            at[on] = back[on, at[on]]
        return out, count

    def fold(self, row: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best paths of many words, one after the other, and their number by word; edges are given by word, in any order."""
        n, longest = len(lengths), int(np.max(start + size, initial=0))
        bpe = self.pieces.kind == "bpe"
        last = np.full((n, longest + 1), START, np.int64)
        back = np.zeros((n, longest + 1), np.int32)
        score = np.full((n, longest + 1), -np.inf)
        score[:, 0] = 0.0
        done = np.zeros((n, longest + 1), bool)
        key = (start + size) * (longest + 1) + start
        order = np.argsort(key.astype(np.int32), kind="stable")
        key, row, ids = key[order], row[order], ids[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        # ends ascend, so what enters a position is settled before its edges leave; of edges with one end the longest comes first
        for a, b in zip(heads.tolist(), np.append(heads, len(key))[1:].tolist(), strict=True):
            end, at = divmod(int(key[a]), longest + 1)
            rows, i = row[a:b], ids[a:b]
            if bpe:
                todo = ~done[rows, end]
                rows, i = rows[todo], i[todo]
                good = self.agree(last[rows, at], i)
                rows, i = rows[good], i[good]
                done[rows, end] = True
            else:
                total = score[rows, at] + np.where(i == UNKNOWN, self.pieces.unknown_score, self.score_of[np.maximum(i, 0)])
                good = total > score[rows, end]
                rows, i = rows[good], i[good]
                score[rows, end] = total[good]
            last[rows, end], back[rows, end] = i, at
        place = np.where(lengths <= longest, lengths, 0)
        place[np.bincount(row, minlength=n) == 0] = 0
        out, count, steps = np.full((n, longest), START, np.int32), np.zeros(n, np.int64), 0
        on = np.flatnonzero(place)
        while len(on):
            out[on, longest - 1 - steps] = last[on, place[on]]
            if (out[on, longest - 1 - steps] == START).any():
                raise AssertionError("a position without a way in")
            count[on] += 1
            place[on] = back[on, place[on]]
            on, steps = on[place[on] > 0], steps + 1
        return out[out != START].astype(np.int64), count

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``data`` (UTF-8 with blanks) and their ``n + 1`` bounds; ``h`` has the hashes of the words."""
        n = len(starts)
        raw = data.tobytes()
        results: list[np.ndarray | None] = [None] * n
        at = np.minimum(np.searchsorted(self.known_hash, h), max(0, len(self.known_hash) - 1))
        maybe = self.known_hash[at] == h if len(self.known_hash) else np.zeros(n, bool)
        for k in np.flatnonzero(maybe).tolist():
            if self.known_bytes[at[k]] == raw[starts[k] : ends[k]]:
                results[k] = self.known_ids[at[k]]
        todo = [k for k in range(n) if results[k] is None]
        words = [raw[starts[k] : ends[k]].decode().replace(" ", SPACE) for k in todo]
        parts: list[tuple[int, str]] = []
        for k, word in enumerate(words):
            parts += [(k, p) for p in self._cut(word)] if len(word) > 48 else [(k, word)]
        found: list[list[np.ndarray]] = [[] for _ in todo]
        pieces_of: list[np.ndarray | None] = [None] * len(parts)
        sizes = np.array([len(p) for _, p in parts], np.int64)
        order = np.argsort(sizes, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(some):
                continue
            size = int(sizes[some[0]])
            if size > LONGEST_WORD:
                for k in some.tolist():
                    pieces_of[k] = self.long(parts[k][1])
                continue
            lot = max(1, 400_000 // size)
            for a in range(0, len(some), lot):
                part = some[a : a + lot]
                codes = np.frombuffer("".join(parts[k][1] for k in part).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(part), size)
                ids, count = self.paths(codes, size)
                odd = (ids == UNKNOWN).any(1)
                for row, k in enumerate(part.tolist()):
                    path = ids[row, : count[row]][::-1]
                    pieces_of[k] = self.with_bytes(path, parts[k][1]) if odd[row] else path
        for (k, _), ids in zip(parts, pieces_of, strict=True):
            found[k].append(ids)
        for k, ids in zip(todo, found, strict=True):
            results[k] = ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in results])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int64), *results]), bounds

    def _cut(self, word: str) -> list[str]:
        """A long word, cut where no piece has the two characters side by side."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        pair = codes[:-1] << _U(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.bigrams, pair), max(0, len(self.bigrams) - 1))
        apart = self.bigrams[at] != pair if len(self.bigrams) else np.ones(len(pair), bool)
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def long(self, word: str) -> np.ndarray:
        """The fold over one very long word, in memory proportional to it."""
        texts = {t: i for i, t in self.text_of.items()}
        last, back, score = [START] * (len(word) + 1), [0] * (len(word) + 1), [0.0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            best = None
            for start in range(max(0, end - self.pieces.longest), end):
                i = texts.get(word[start:end], UNKNOWN if start == end - 1 else -1)
                if i == -1:
                    continue
                if self.pieces.kind == "bpe":
                    if last[start] < 0 or i == UNKNOWN or self.agree(np.array([last[start]]), np.array([i]))[0]:
                        last[end], back[end] = i, start
                        break
                else:
                    total = score[start] + (self.pieces.unknown_score if i == UNKNOWN else float(self.score_of[i]))
                    if best is None or total > best:
                        best, last[end], back[end] = total, i, start
            score[end] = best or 0.0
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at = back[at]
        ids = np.array(path[::-1], np.int64)
        return self.with_bytes(ids, word) if (ids == UNKNOWN).any() else ids

    def with_bytes(self, path: np.ndarray, word: str) -> np.ndarray:
        """Unknown characters as byte pieces, if the model has them; neighbouring ones as one unknown piece otherwise."""
        out, at = [], 0
        for i in path.tolist():
            if i != UNKNOWN:
                out.append(i)
                at += len(self.text_of[i])
                continue
            if self.pieces.byte_ids:
                out += [self.pieces.byte_ids[b] for b in word[at].encode()]
            elif not out or out[-1] != self.pieces.unknown_id:
                out.append(self.pieces.unknown_id)
            at += 1
        return np.array(out, np.int64)


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(len(codes), _MULT)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[_U(1)], np.full(len(codes), _INVERSE)]), dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes) * powers[:-1])]), inverse


class Plain:
    """What every id stands for, as bytes: pieces with blanks for their sign, byte pieces, nothing for control pieces."""

    def __init__(self, pieces: Pieces):
        known = set(pieces.ids)
        of_byte = {i: bytes([b]) for b, i in pieces.byte_ids.items()}
        parts = []
        for i in range(max(pieces.names, default=-1) + 1):
            name = pieces.names.get(i, "")
            parts.append(of_byte.get(i, name.replace(SPACE, " ").encode() if i in known else " ⁇ ".encode() if i == pieces.unknown_id else b""))
        self.to = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.to[ids + 1] - self.to[ids]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other. A text's begin with the blank that encoding has put there."""
        return self.data[ranges(self.to[ids], self.sizes(ids))]


def _apart(pieces: Pieces) -> np.ndarray:
    """By two ASCII characters: whether no piece has them side by side, so that a word can be cut there. Blanks stand for their sign.

    Without byte pieces, unknown characters in a row are one piece, and words stay whole.
    """
    table = np.full((256, 256), False)
    if pieces.byte_ids:
        table[:128, :128] = True
        for text in pieces.texts:
            raw = text.replace(SPACE, " ").encode()
            table[list(raw[:-1]), list(raw[1:])] = False
    return table


def _cut(batches: Iterator[pa.RecordBatch], apart: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch, pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """Slices of texts: number, rows, texts after the blank that encoding puts there, bounds by word, distinct words, and a word's place among these.

    The number has the task, the slice and a checksum of the words: a task that is run again over other rows has other numbers.
    """
    for n, piece in enumerate(slices(batches, "text", SLICE_BYTES, owner="pieces")):
        text = pc.fill_null(piece.column("text"), "")
        text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise("", text, " "))
        data, bounds = utf8(pc.replace_substring(text, SPACE, " "))
        head = np.zeros(len(data), bool)
        head[1:] = apart.ravel()[data[:-1].astype(np.uint16) << 8 | data[1:]] | (data[1:] == 32) & (data[:-1] != 32)
        head[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(head)
        every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        found = every.dictionary_encode()
        places = found.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(places, minlength=len(found.dictionary)), kind="stable")  # the commonest first: small numbers pack well
        words = found.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        raw, _ = utf8(words)
        number = TaskContext.get().partitionId() << 44 | (n & 0xFFF) << 32 | zlib.crc32(raw)
        yield number, piece, text, np.searchsorted(starts, bounds), words, rank[places]


def _slice_words(apart: np.ndarray):
    """(slice, words): the distinct words of each slice."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, _, words, _ in _cut(batches, apart):
            words = pc.replace_substring(words.cast(pa.string()), " ", SPACE)
            yield pa.record_batch([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["slice", "words"])

    return listed


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all before the second ones, compressed; their count comes first."""
    cells = np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4)
    return len(cells).to_bytes(4, "little") + pa.compress(cells.T.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    cells = np.frombuffer(pa.decompress(blob[4:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(cells.reshape(4, -1).T).view(np.int32).ravel()


def _slice_rows(apart: np.ndarray):
    """Rows with the places of their words in the slice's list, byte by byte, and a digest of the text."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece, text, bounds, _, places in _cut(batches, apart):
            found = [_packed(places[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            raw, to = utf8(text)
            others = [n for n in piece.schema.names if n != "text"]
            yield pa.record_batch(
                [*(piece.column(n) for n in others), pa.array(np.full(len(piece), number, np.int64)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(found, pa.binary()), pa.array(_digests(raw, to), pa.binary())],
                names=[*others, "slice", "n_words", "places", "digest"],
            )

    return coded


def _digests(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _answered(shared):
    """The ids of a lot's words go to the slices that have them."""

    def answer(edges: pa.Table, pairs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"slice": [], "places": [], "sizes": [], "ids": []}
        if len(edges):
            words, ids = _folded(_lattice(shared), edges)
            which = pc.index_in(pairs.column("asked").combine_chunks(), words).to_numpy(zero_copy_only=False).astype(np.int64)
            number, place = (pairs.column(c).to_numpy() for c in ("slice", "place"))
            order = np.lexsort((place, number))
            which, number, place = which[order], number[order], place[order]
            to, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
            heads = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
            for a, b in zip(heads.tolist(), np.append(heads, len(number))[1:].tolist(), strict=True):
                some = which[a:b]
                sizes = to[some + 1] - to[some]
                out["slice"].append(int(number[a]))
                out["places"].append(_packed(np.diff(place[a:b], prepend=0)))
                out["sizes"].append(_packed(sizes))
                out["ids"].append(_packed(flat[ranges(to[some], sizes)]))
        return pa.table(out, schema=pa.schema([("slice", pa.int64()), *((n, pa.binary()) for n in ("places", "sizes", "ids"))]))

    return answer


def _plain(shared) -> Plain:
    kept = kept_by("pieces")
    if kept.get("plain run") != shared.value[1]:
        kept |= {"plain run": shared.value[1], "plain": Plain(shared.value[0])}
    return kept["plain"]


def _written(shared, names: list[str], check: bool):
    """The ids of a slice's texts, from those of its words; they are decoded and held against the text if that is asked for."""

    def write(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            raise RuntimeError("the rows of a slice have changed between two readings")
        got = {c: [_unpacked(x) for x in answers.column(c).to_pylist()] for c in ("places", "sizes", "ids")}
        none = np.zeros(0, np.int32)
        place = np.concatenate([none, *(np.cumsum(x, dtype=np.int32) for x in got["places"])])
        sizes, ids = np.concatenate([none, *got["sizes"]]), np.concatenate([none, *got["ids"]])
        size_of, start_of = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
        size_of[place], start_of[place] = sizes, np.cumsum(sizes) - sizes
        held = rows.column("n_words").to_numpy().astype(np.int64)
        plain = _plain(shared) if check else None
        seen, parts = -1, []
        heads = np.unique(np.searchsorted(np.cumsum(held), np.arange(0, held.sum(), WORDS_AT_ONCE), side="right"))
        for a, b in zip([0, *heads[heads > 0].tolist()], [*heads[heads > 0].tolist(), len(rows)], strict=True):
            some = rows.slice(a, b - a)
            which = np.concatenate([none, *(_unpacked(x) for x in some.column("places").to_pylist())])
            seen = max(seen, int(np.max(which, initial=-1)))
            if seen >= len(place):
                break
            n = size_of[which]
            out = ids[ranges(start_of[which], n)]
            to = np.concatenate([[0], np.cumsum(by_text(np.add, n, np.concatenate([[0], np.cumsum(held[a:b])]), 0))]).astype(np.int64)
            columns = [*(some.column(c) for c in names), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(out))]
            if check:
                ends = np.concatenate([[0], np.cumsum(plain.sizes(out))])[to]
                columns.append(pa.array([x == y for x, y in zip(_digests(plain.decode(out), ends), some.column("digest").to_pylist(), strict=True)], pa.bool_()))
            parts.append(pa.table(columns, names=[*names, "ids", *(["round_trip"] if check else [])]))
        if seen + 1 != len(place):
            raise RuntimeError("the words of a slice have changed between two readings")
        return pa.concat_tables(parts)

    return write


def common_words(docs: DataFrame, most: int, sample_docs: int) -> DataFrame:
    """(word): the ``most`` commonest words of about ``sample_docs`` documents, for trials of the two forms of the lattice."""
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample_docs))) == 0)
    spaced = F.concat(F.lit(" "), F.col("text").cast("string"))
    words = picked.where("text <> ''").select(F.explode(F.split(spaced, "(?<=[^ ])(?= )")).alias("word"))
    words = words.where(f"char_length(word) <= {LONGEST_WORD}").withColumn("word", F.translate("word", " ", SPACE))
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).select("word")


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` with ``ids``, the pieces of the whole text, in place of ``text``.

    Ids are those that the model file defines: a blank is put before the text, blanks are
    kept, the model's own sign for a blank counts as one, characters without a piece become
    byte pieces. A null or empty text has no
    pieces. ``docs`` is read more than once and should be a stored table; rows that lie otherwise at the next reading raise.
    Other columns stay, but for one that is named ``ids``.
    """
    return _encoded(docs, model, False)


def _encoded(docs: DataFrame, model: str, check: bool) -> DataFrame:
    pieces = load_pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, uuid.uuid4().hex))
    rows = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    lots = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // LOT_BYTES
    fields = [f for f in rows.schema.fields if f.name != "text"]
    names = [f"c{k}" for k in range(len(fields))]  # inner names, so that no two columns clash
    inner = rows.select(*(F.col(f"`{f.name}`").alias(c) for c, f in zip(names, fields, strict=True)), "text")
    schema = [f"{c} {f.dataType.simpleString()}" for c, f in zip(names, fields, strict=True)]

    apart = _apart(pieces)
    listed = inner.mapInArrow(_slice_words(apart), "slice long, words array<string>")
    pairs = listed.select("slice", F.posexplode("words").alias("place", "word"))
    pairs = pairs.repartition(_tasks(lots), _lot(lots)).withColumn("lot", _lot(lots))
    asked = pairs.select("slice", "place", F.col("word").alias("asked"), F.col("lot").alias("of_lot"))
    # the words' first places are looked at so that both readings of the pairs have the same columns and share one shuffle
    distinct = pairs.groupBy("lot", "word").agg(F.min("slice").alias("first"), F.min("place").alias("place")).where("first IS NOT NULL AND place >= 0")
    found = _edges(distinct, pieces).groupBy("lot").cogroup(asked.groupBy("of_lot"))
    answers = found.applyInArrow(_answered(shared), "slice long, places binary, sizes binary, ids binary")

    coded = inner.mapInArrow(_slice_rows(apart), ", ".join([*schema, "slice long", "n_words int", "places binary", "digest binary"]))
    more = ["ids", "round_trip"] if check else ["ids"]
    back = coded.groupBy("slice").cogroup(answers.withColumnRenamed("slice", "of_slice").groupBy("of_slice"))
    out = back.applyInArrow(_written(shared, names, check), ", ".join([*schema, *["ids array<int>", "round_trip boolean"][: len(more)]]))
    return out.select(*(F.col(c).alias(f.name) for c, f in zip(names, fields, strict=True)), *more)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with ``text``, what ``ids`` stand for; no ids give an empty text, null ids a null one.

    Bytes that are no UTF-8 become U+FFFD. An id outside the model raises.
    """
    plain = Plain(load_pieces(model))

    def decode(ids) -> str | None:
        if ids is None:
            return None
        raw = plain.decode(np.asarray(ids, np.int64)).tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(decode, na_action=None)

    return rows.withColumn("text", texts("ids"))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, ids, n_pieces, round_trip (whether the ids decode to the text).

    Ids are decoded where they come together, and a digest of the bytes compared with the text's. A null text
    has no pieces and decodes to an empty text, which counts as a round trip. Rows that
    repeat give one row each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _encoded(rows, model, True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(piece, id, score) of a model file."""
    pieces = load_pieces(model)
    return spark.createDataFrame(list(zip(pieces.texts, pieces.ids, pieces.scores, strict=True)), "piece string, id int, score double")
