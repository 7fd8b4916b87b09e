"""Forests of BK-trees over fingerprints, built and searched level by level with numpy.

A forest has one tree per bucket. A child hangs on its parent under their Hamming distance as an integer key; of the
items that reach a parent at one distance, the first becomes the child and the others go down to it. A search enters a
child only if its key is within the radius of the query's distance to the parent.

Fingerprints are arrays of unsigned 64-bit words, shape (n, words).
"""

from __future__ import annotations

import numpy as np

#: Words of query-node pairs that a search compares at once.
STEP = 1 << 19


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """items: fingerprints, sorted by bucket; starts: where each bucket begins."""

    def __init__(self, items: np.ndarray, starts: np.ndarray):
        n = len(items)
        self.items = items
        #: Nodes that searches have compared with a query.
        self.visited = 0
        bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self.root = starts[bucket]  # of each item, its bucket's first
        child_of, key, node = [], [], []
        at = np.arange(n)
        parent = self.root.copy()
        mask = at != parent
        at, parent = at[mask], parent[mask]
        while len(at):
            d = distance(items[at], items[parent])
            order = np.lexsort((at, d, parent))
            at, parent, d = at[order], parent[order], d[order]
            first = np.ones(len(at), dtype=bool)
            first[1:] = (parent[1:] != parent[:-1]) | (d[1:] != d[:-1])
            heads = at[first]
            child_of.append(parent[first])
            key.append(d[first])
            node.append(heads)
            parent = heads[np.cumsum(first) - 1][~first]
            at = at[~first]
        if node:
            child_of, key, node = map(np.concatenate, (child_of, key, node))
        else:
            child_of = key = node = np.zeros(0, dtype=np.int64)
        order = np.lexsort((key, child_of))
        # one sorted number per edge, so that the edges of a parent within a range of keys are a slice
        self.wide = 64 * items.shape[1] + 1
        self.edges = (child_of * self.wide + key)[order]
        self.child = node[order]

    def pairs(self, radius: int):
        """Yield arrays (i, j), i > j in the order of items: all pairs of a bucket at most radius apart."""
        for q, node in self.search(self.items, self.root, radius):
            own = q > node
            if own.any():
                yield q[own], node[own]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yield arrays (query, item): all items at most radius apart from a query in the tree that begins at its root."""
        n, most = len(queries), max(1024, STEP // queries.shape[1])
        step = max(1, most // 16)
        for begin in range(0, n, step):
            stack = [(np.arange(begin, min(n, begin + step)), roots[begin : begin + step])]
            while stack:
                q, node = stack.pop()
                if len(q) > most:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                self.visited += len(q)
                d = distance(queries[q], self.items[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edges, node * self.wide + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.edges, node * self.wide + np.minimum(d + radius, self.wide - 1), "right")
                count = high - low
                if total := int(count.sum()):
                    spread = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(total)
                    stack.append((np.repeat(q, count), self.child[spread]))


def join_up(n: int, pairs) -> np.ndarray:
    """The smallest index reachable from each of n items over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:  # short paths to the smallest
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label
