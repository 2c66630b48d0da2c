"""FM-index over integer sequences: suffix array, wavelet matrix, sampled positions.

Everything works on whole arrays of queries at once, so the cost of a search is a few
array operations per pattern symbol and wavelet level, whatever the number of patterns.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the first round ranks several symbols at once."""
    n = len(seq)
    if n == 0:
        return np.empty(0, np.int64)
    bits = max(1, int(seq.max() + 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        if j < n:
            key[: n - j] += seq[j:].astype(np.int64) + 1
    while True:
        order = np.argsort(key, kind="quicksort")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        step = np.ones(n, np.int64)
        step[1:] = ranked[1:] != ranked[:-1]
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        if width < n:
            key[: n - width] += rank[width:]
        width *= 2


class BitRank:
    """Bits with constant-time rank: packed words and the counts before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(self.before[-1]) - int(np.bitwise_count(self.words[-1]))

    def one(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix: access and rank over an alphabet in one pass per bit."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, BitRank]] = []
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (seq >> shift & 1).astype(np.uint8)
            self.levels.append((shift, BitRank(bit)))
            one = bit.astype(bool)
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``i`` elements."""
        start = np.zeros_like(i)
        for shift, bits in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.one(start), bits.one(i)
            start = np.where(one, bits.zeros + a, start - a)
            i = np.where(one, bits.zeros + b, i - b)
        return i - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its rank before ``i``."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for shift, bits in self.levels:
            one = bits.at(i)
            symbol |= one.astype(np.int64) << shift
            a, b = bits.one(start), bits.one(i)
            start = np.where(one, bits.zeros + a, start - a)
            i = np.where(one, bits.zeros + b, i - b)
        return symbol, i - start


class FMIndex:
    """Counts and locates integer patterns in one sequence.

    Symbols are 1 and above; 0 ends the sequence. Every ``sample``-th text position is kept;
    other positions are found by walking back to the next kept one.
    """

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 16) -> None:
        text = np.append(seq.astype(np.int64), 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = Wavelet(last, symbols)
        kept = order % sample == 0
        self.kept = BitRank(kept.astype(np.uint8))
        self.positions = order[kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of each row of equally long ``patterns``, searched backward."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[:, column]
            low = self.starts[symbol] + self.wavelet.rank(symbol, low)
            high = self.starts[symbol] + self.wavelet.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows``."""
        out = np.empty(len(rows), np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            found = self.kept.at(at)
            if found.any():
                out[todo[found]] = self.positions[self.kept.one(at[found])] + steps
                todo, at = todo[~found], at[~found]
            if len(todo):
                symbol, rank = self.wavelet.step(at)
                at = self.starts[symbol] + rank
            steps += 1
        return out
