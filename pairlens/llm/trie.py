"""Elias-Fano n-gram trie: contexts, and below each its successors with quantised scores.

Level one is the rising sequence of context hashes, level two the rising sequence
of (context rank, word) pairs, and between them monotone pointers lead from a
context to the range of its successors. All three are Elias-Fano sequences: low
bits packed at a fixed width, high bits in unary. They stay packed: a value is
read by a select on the unary bits, helped by one count for each 512 bits. A
successor is searched between its context's two pointers only. Scores are 8-bit
codes. The levels lie in one file that is memory-mapped.
"""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64
WORD_BITS = 40
#: 64-bit words of one entry of a directory.
_STEP = 8


class Bits:
    """A bit sequence in 64-bit words with a count of ones before each 512 bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).reshape(-1, _STEP).sum(1, dtype=np.int64)
        self._ones = np.concatenate([[0], np.cumsum(ones)])
        self._zeros = np.arange(len(self._ones)) * (64 * _STEP) - self._ones

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        wide = np.zeros(max(1, -(-len(bits) // (64 * _STEP))) * 64 * _STEP, np.uint8)
        wide[: len(bits)] = bits
        return cls(np.packbits(wide, bitorder="little").view(U))

    def select(self, k: np.ndarray, ones: bool = True) -> np.ndarray:
        """Place of the k-th one, or zero, counted from 0."""
        before = self._ones if ones else self._zeros
        block = np.searchsorted(before, k, "right") - 1
        rest = k - before[block]
        at = block * _STEP
        word = self.words[at] if ones else ~self.words[at]
        for _ in range(_STEP - 1):
            n = np.bitwise_count(word).astype(np.int64)
            on = rest >= n
            if not on.any():
                break
            rest = np.where(on, rest - n, rest)
            at = at + on
            word = np.where(on, self.words[at] if ones else ~self.words[at], word)
        place = at * 64
        for half in (32, 16, 8, 4, 2, 1):
            low = word & U((1 << half) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            on = rest >= n
            rest = np.where(on, rest - n, rest)
            place = place + half * on
            word = np.where(on, word >> U(half), low)
        return place


class EliasFano:
    """A rising sequence of unsigned 64-bit values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, Bits(high)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, U), np.zeros(_STEP, U))
        bits = max(0, int(values[-1]).bit_length() - n.bit_length())
        high = (values >> U(bits)).astype(np.int64)
        unary = np.zeros(n + int(high[-1]) + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        low = np.zeros(n * bits // 64 + 2, U)
        if bits:
            part = values & U((1 << bits) - 1)
            at = np.arange(n, dtype=U) * U(bits)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U(bits) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        return cls(n, bits, low, Bits.of(unary).words)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.low_bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        value = self.low[word] >> shift
        over = shift > U(0)
        value = np.where(over, value | (self.low[word + 1] << (U(64) - np.where(over, shift, U(1)))), value)
        return value & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        return ((self.high.select(i) - i).astype(U) << U(self.low_bits)) | self._low(i)

    def _ranges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which positions values with the high bits of x lie."""
        h = np.minimum(x >> U(self.low_bits), U(len(self.high.words) * 64 - self.n - 1)).astype(np.int64)
        ends = self.high.select(h, False) - h
        return np.where(h > 0, self.high.select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0), ends

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Positions of values, -1 where absent, by binary search between lo and hi or, without them, among those that share the high bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        lo, hi = self._ranges(x) if lo is None else (lo.copy(), hi.copy())
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.get(mid) < x[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        hit = np.flatnonzero(lo < end)
        hit = hit[self.get(lo[hit]) == x[hit]]
        out[hit] = lo[hit]
        return out


class Codes:
    """Numbers as 8-bit codes: the means of 256 equal ranges, so no error exceeds a range; up to 256 different numbers stay exact."""

    def __init__(self, book: np.ndarray, codes: np.ndarray):
        self.book, self.codes = book, codes

    @classmethod
    def encode(cls, values: np.ndarray) -> Codes:
        distinct, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
        if len(distinct) <= 256:
            return cls(distinct if len(distinct) else np.zeros(1), inverse.astype(np.uint8))
        group = np.minimum((distinct - distinct[0]) / (distinct[-1] - distinct[0]) * 256, 255).astype(int)
        used, group = np.unique(group, return_inverse=True)
        book = np.bincount(group, distinct * n) / np.bincount(group, n)
        return cls(book, group[inverse].astype(np.uint8))

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.book[self.codes[i]]


class NGramTrie:
    """Contexts with a backoff score, and their successors with a score each."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, backoff: Codes, scores: Codes):
        self.contexts, self.pointers, self.successors, self.backoff, self.scores = contexts, pointers, successors, backoff, scores

    @classmethod
    def build(cls, contexts: np.ndarray, backoff: np.ndarray, rank: np.ndarray, word: np.ndarray, score: np.ndarray) -> NGramTrie:
        """contexts rising; (rank, word) rising, word below 2**WORD_BITS."""
        pointers = np.searchsorted(rank, np.arange(len(contexts) + 1)).astype(U)
        return cls(EliasFano.encode(contexts), EliasFano.encode(pointers), EliasFano.encode((rank.astype(U) << U(WORD_BITS)) | word), Codes.encode(backoff), Codes.encode(score))

    def mapped(self) -> NGramTrie:
        """The same trie with its levels in a memory-mapped file, which has no name and goes with the process."""
        levels = (self.contexts, self.pointers, self.successors)
        arrays = [x for e in levels for x in (e.low, e.high.words)] + [self.backoff.codes, self.scores.codes]
        with tempfile.TemporaryFile() as f:
            places = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 64))
                places.append(f.tell())
                f.write(a.tobytes())
            f.write(b"\0" * 64)
            f.flush()
            views = [np.memmap(f, a.dtype, "r", offset=p, shape=a.shape) if a.size else a for a, p in zip(arrays, places, strict=True)]
        seqs = [EliasFano(e.n, e.low_bits, views[2 * i], views[2 * i + 1]) for i, e in enumerate(levels)]
        return NGramTrie(*seqs, Codes(self.backoff.book, views[6]), Codes(self.scores.book, views[7]))

    def query(self, context: np.ndarray, of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, seen) of each word after ``context[of]``: the successor's score, else the context's backoff score, else 0."""
        rank = self.contexts.find(context)
        known = rank >= 0
        first = np.where(known, rank, 0)
        lo, hi = ((self.pointers.get(first + i).astype(np.int64) if self.contexts.n else np.zeros(len(context), np.int64)) * known for i in range(2))
        below = self.backoff.get(first) * known if self.contexts.n else np.zeros(len(context))
        at = self.successors.find((first[of].astype(U) << U(WORD_BITS)) | word, lo[of], hi[of])
        out = below[of]
        seen = at >= 0
        out[seen] = self.scores.get(at[seen])
        return out, seen
