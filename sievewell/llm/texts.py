"""Arrow batches of texts as byte arrays: slices, words and word shingles, without a Python loop over words.

A word is a maximal run of ASCII letters, digits, underscore and bytes of other
characters, in lower case. All hashes are fixed functions of the bytes, so a task
that is run again gives the same values.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_SEGMENT = 1 << 19
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_MIX1 = _U(0xBF58476D1CE4E5B9)
_MIX2 = _U(0x94D049BB133111EB)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_KEPT: dict[str, object] = {}


def kept_by(owner: str) -> dict[str, object]:
    """What a worker process keeps for its next task of the same operator; another operator's is dropped."""
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner
    return _KEPT


def give_back() -> None:
    """Return freed memory to the machine: workers are used again, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str = "text", max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 14, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about ``max_bytes``, and no more than ``max_rows``; a longer text stands alone.

    Before the first piece, what other operators have kept in the process is dropped; after the last one memory is given back.
    """
    kept_by(owner)
    for batch in batches:
        col = batch.column(column)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if (total and total + n > max_bytes) or i - first == max_rows:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(size):
            yield batch.slice(first)
    give_back()


def utf8(col: pa.Array, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the ``n + 1`` bounds of the texts. Null: empty."""
    col = pc.fill_null(col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col, "")
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1].copy()
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    if pad:
        data = np.concatenate([data, np.zeros(pad, np.uint8)])
    return data, bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[inner] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, side="right")))
        high = int(ends[to - 1])
        powers = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[low:high]] * powers[:-1], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((sums[e] - sums[s]) * _powers(high - low + 1, True)[s] + (e - s).astype(np.uint64))
        at = to
    return out


_TABLES: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    table = _TABLES.get(inverse)
    if table is None or len(table) < n:
        size = max(n, _SEGMENT + 1)
        steps = np.full(size, _INVERSE if inverse else _MULT, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if size > 4 * _SEGMENT:
            return table[:n]  # a very long word: not kept
        _TABLES[inverse] = table
    return table[:n]


def lower_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the ``n + 1`` bounds of each text's words."""
    data, bounds = utf8(pc.utf8_lower(col))
    starts, ends = word_bounds(data, bounds)
    return span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` following words, and their bounds by text. A text of fewer words has one: all of them."""
    counts = np.diff(bounds)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(to[-1]), np.uint64)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for j in range(1, size):
            rolled = rolled * _MULT + words[j : len(words) - size + 1 + j]
        long = counts >= size
        first = np.repeat(bounds[:-1][long] - to[:-1][long], made[long])
        at = np.concatenate([np.zeros(0, np.int64), *([_ranges(to[:-1][long], made[long])] if long.any() else [])])
        out[at] = mixed(rolled[at + first])
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = _U(counts[i])
        with np.errstate(over="ignore"):
            for w in words[bounds[i] : bounds[i + 1]]:
                h = h * _MULT + w
        out[to[i]] = mixed(np.array([h], np.uint64))[0]
    return out, to


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each pair, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)


ranges = _ranges


def by_text(ufunc, values: np.ndarray, bounds: np.ndarray, empty):
    """``ufunc.reduceat`` by text, with ``empty`` for texts without values."""
    out = np.full((len(bounds) - 1, *values.shape[1:]), empty, dtype=np.result_type(values.dtype, type(empty)) if values.dtype != np.uint64 else np.uint64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = ufunc.reduceat(values, bounds[some], axis=0)
    return out
