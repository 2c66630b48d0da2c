"""BK-trees over bit sketches: children keyed by their Hamming distance to the parent.

A forest holds one tree per bucket of a shard and is built and searched for all buckets at once:
each round places one node per group and sends the other members along the edge of their
distance; a search follows only edges within the radius of the distance to the node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of two arrays of 64-bit words."""
    d = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int32)
    for j in range(1, a.shape[1]):
        d += np.bitwise_count(a[:, j] ^ b[:, j])
    return d


class Forest:
    """``points`` is (n, words) of uint64; ``bucket`` is sorted and gives each point's tree."""

    def __init__(self, points: np.ndarray, bucket: np.ndarray) -> None:
        n = len(points)
        self.points, self.edges = points, points.shape[1] * 64 + 1
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        first = np.ones(n, bool)
        first[1:] = bucket[1:] != bucket[:-1]
        roots = np.flatnonzero(first)
        self.root = roots[np.cumsum(first) - 1] if n else np.empty(0, np.int64)
        rest = np.flatnonzero(~first)
        at = self.root[rest]
        while len(rest):
            d = hamming(points[rest], points[at]).astype(np.int64)
            order = np.lexsort((rest, d, at))
            rest, at, d = rest[order], at[order], d[order]
            first = np.ones(len(rest), bool)
            first[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
            node = rest[first]
            parent[node], edge[node] = at[first], d[first]
            at = node[np.cumsum(first) - 1]
            rest, at = rest[~first], at[~first]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * self.edges + edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) at most ``radius`` apart, for queries each starting at its ``root``."""
        stack = [(np.arange(i, min(i + most, len(queries))), root[i : i + most]) for i in range(0, len(queries), most)]
        while stack:
            q, node = stack.pop()
            if len(q) > 2 * most:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = hamming(queries[q], self.points[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.key, node * self.edges + np.maximum(0, d - radius))
            high = np.searchsorted(self.key, node * self.edges + np.minimum(self.edges - 1, d + radius), "right")
            n = high - low
            if n.any():
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                stack.append((q[which], self.child[at]))
