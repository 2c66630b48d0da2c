"""MinHash signatures of sets of 64-bit features, for whole batches at once."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word to a stable 64-bit hash; forgets everything when it has grown too large."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


def shingles(lists: list[list[str]], width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words of every list, and where each list's shingles begin (n + 1 bounds).

    Within a list they are sorted. Lists shorter than ``width`` have none.
    """
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((hashes[w] for x in lists for w in x), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(lists)), n)
    if len(flat) < width:
        return np.empty(0, np.uint64), np.zeros(len(lists) + 1, np.int64)
    value = flat[: len(flat) - width + 1].copy()
    for j in range(1, width):
        value = mix(value) + flat[j : len(flat) - width + 1 + j]
    value = mix(value)
    inside = owner[: len(value)] == owner[width - 1 :]
    value, owner = value[inside], owner[: len(inside)][inside]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(lists) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """``k`` minimum hashes of every non-empty set, one row per set; empty sets must be left out."""
    out = np.empty((len(bounds) - 1, k), np.uint64)
    if len(values):
        for j in range(k):
            seed = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
            x = (values ^ seed) * _M1
            x ^= x >> np.uint64(32)
            x *= _M2
            out[:, j] = np.minimum.reduceat(x, bounds[:-1])
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of ``rows`` neighbouring minima; the band number is part of the key."""
    n, k = signature.shape
    keys = np.zeros((n, k // rows), np.uint64)
    for b in range(k // rows):
        key = np.full(n, np.uint64(b + 1))
        for j in range(rows):
            key = mix(key ^ signature[:, b * rows + j])
        keys[:, b] = key
    return keys
