"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes outside space and 0x09-0x0D, which for UTF-8
is the pattern ``[^\\x20\\x09-\\x0D]+``. Words never cross texts. Every word gets
a 64-bit polynomial hash, computed with prefix sums over whole blocks of texts,
so the cost is a few array passes a byte and nothing runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = np.array(x, dtype=U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_EXACT = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: For bare words: all ASCII but letters and digits parts words.
_MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64 for i in 0..n-1, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1024, 2 * len(have[0]) if have else 0)
        up = np.full(size, base, dtype=U)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=U)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


@dataclass
class Words:
    """Words of a block of texts: text i has words bounds[i]..bounds[i+1]-1."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray | None = None

    def stems(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes."""
        return mix((self.sums[np.minimum(self.starts + size, self.ends)] - self.sums[self.starts]) * powers(_BASE, len(self.data) + 1)[1][self.starts] + U(1))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, bare: bool = False) -> Words:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, offsets, z, z, np.zeros(len(offsets), np.int64), z.astype(U), np.zeros(1, U))
    solid = ~(_MARKS if bare else _SPACE)[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    up, down = powers(_BASE, n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _EXACT)[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes, sums)


def blocks(column: pa.Array, lower: bool, size: int = BLOCK_BYTES, bare: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of rows of about ``size`` bytes."""
    data, off = texts_of(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, end, words(data[off[at] : off[end]], off[at : end + 1] - off[at], lower, bare)
        at = end


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about ``size`` bytes in column number ``text``, whatever they came in: that bounds a worker's memory."""
    held, filled = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        _, off = texts_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size - filled, "right")) - 1)
            held.append(batch.slice(at, end - at))
            filled += int(off[end] - off[at])
            if end < batch.num_rows or filled >= size:
                yield joined()
                held, filled = [], 0
            at = end
    if held:
        yield joined()


def all_words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds by row) of a whole column."""
    hashes, bounds, base = [], [np.zeros(1, np.int64)], 0
    for _, _, w in blocks(column, lower):
        hashes.append(w.hashes)
        bounds.append(w.bounds[1:] + base)
        base += len(w.hashes)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.concatenate(bounds)


class Runs:
    """Hashes of runs of consecutive words, any length, from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self._down = powers(_WORD_BASE, n + 1)
        self._sums = np.empty(n + 1, U)
        self._sums[0] = 0
        np.cumsum(hashes * up[:n], out=self._sums[1:])

    def at(self, positions: np.ndarray, length: int) -> np.ndarray:
        return mix((self._sums[positions + length] - self._sums[positions]) * self._down[positions])


def run_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Positions from which ``length`` words fit in their text."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return at + np.arange(len(at))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run starts): equal keys stand together, each run in rising position.

    Sorts high key bits joined with the position, which is several times faster
    than a stable argsort; the few runs that mix keys with equal high bits are
    sorted again in full.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(1, int(n - 1).bit_length())
    low = U((1 << bits) - 1)
    packed = (keys & ~low) | np.arange(n, dtype=U)
    packed.sort()
    order = (packed & low).astype(np.int64)
    high = packed & ~low
    sorted_keys = keys[order]
    step = sorted_keys[1:] != sorted_keys[:-1]
    mixed = np.flatnonzero(step & (high[1:] == high[:-1]))
    if len(mixed):
        for lo in np.unique(np.searchsorted(high, high[mixed], "left")):
            hi = int(np.searchsorted(high, high[lo], "right"))
            part = order[lo:hi]
            order[lo:hi] = part[np.lexsort((part, keys[part]))]
        sorted_keys = keys[order]
        step = sorted_keys[1:] != sorted_keys[:-1]
    return order, np.concatenate([[0], np.flatnonzero(step) + 1])
