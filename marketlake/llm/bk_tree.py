"""BK-trees over 64-bit fingerprints, many trees at a time, in numpy.

Each bucket has a tree. A node's children are keyed by their Hamming distance to it, so a
search that stands at distance d from a node follows only the edges d - radius to
d + radius. Trees are built level by level and searched by frontiers, so all buckets of a
task advance together and memory is bounded by ``CHUNK`` searches at a time.
"""

from __future__ import annotations

import numpy as np

CHUNK = 100_000


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree per bucket. ``links`` asks that the fingerprints of a bucket all differ, and
    needs the distances met while building, which are kept unless said otherwise.
    """

    def __init__(self, bucket: np.ndarray, prints: np.ndarray, keep: bool = True):
        self.prints = prints
        n = len(prints)
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int64)
        self.passed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        items = np.argsort(bucket, kind="stable")
        place = np.unique(bucket[items], return_inverse=True)[1]
        self.root = None
        while len(items):
            first = np.r_[True, place[1:] != place[:-1]]
            pivots = items[first]
            if self.root is None:
                self.root = np.empty(n, np.int64)
                self.root[items] = pivots[np.cumsum(first) - 1]
            below = ~first
            pivot = pivots[np.cumsum(first) - 1][below]
            items = items[below]
            apart = distance(prints[items], prints[pivot])
            if keep:
                self.passed.append((items, pivot, apart))
            order = np.lexsort((apart, pivot))
            items, pivot, apart = items[order], pivot[order], apart[order]
            place = pivot * 128 + apart
            heads = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
            parent[items[heads]], edge[items[heads]] = pivot[heads], apart[heads]
        self.child = np.lexsort((edge, parent))
        self.child_key = (parent * 128 + edge)[self.child]

    def _children(self, node: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = 1):
        """Children of each node with edges low..high: (index into node, child)."""
        start = np.searchsorted(self.child_key, node * 128 + np.maximum(low, least))
        stop = np.searchsorted(self.child_key, node * 128 + np.maximum(high, 0), side="right")
        count = np.maximum(stop - start, 0)
        which = np.repeat(np.arange(len(node)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, self.child[start[which] + offset]

    def links(self, radius: int):
        """Pairs at most ``radius`` apart, as arrays (i, j), chunk by chunk.

        They connect all that all such pairs connect. Two fingerprints near the same node
        are linked through it, so edges up to ``radius`` are not searched from a print
        that is itself that near.
        """
        for items, pivot, apart in self.passed:
            near = apart <= radius
            yield items[near], pivot[near]
            # the rest meets the subtrees on nearer edges; those on farther ones meet it
            far = np.flatnonzero(~near)
            for at in range(0, len(far), CHUNK):
                some = far[at : at + CHUNK]
                d = apart[some]
                which, node = self._children(pivot[some], d - radius, d - 1)
                query = items[some][which]
                while len(query):
                    parts = []
                    for cut in range(0, len(query), 20 * CHUNK):
                        q, n = query[cut : cut + 20 * CHUNK], node[cut : cut + 20 * CHUNK]
                        d = distance(self.prints[q], self.prints[n])
                        hit = d <= radius
                        yield q[hit], n[hit]
                        low = np.where(hit, radius + 1, d - radius)
                        which, child = self._children(n, low, d + radius)
                        parts.append((q[which], child))
                    query = np.concatenate([p[0] for p in parts])
                    node = np.concatenate([p[1] for p in parts])

    def earlier(self, radius: int, most: int, asked: np.ndarray, fits=None):
        """Pairs (i, j) at most ``radius`` apart, j before i in i's bucket, chunk by chunk, for
        the asked i. A search ends at the level at which it has ``most`` hits. ``fits`` takes
        arrays i and j and tells which pairs count as hits.

        Items must be sorted by bucket. A node comes before all nodes under it, so a search
        leaves a subtree at the first node that comes later than what it asks for. Equal
        fingerprints are children on edge 0.
        """
        query = np.flatnonzero(asked)
        query = query[self.root[query] < query] if len(query) else query
        node = self.root[query] if len(query) else query
        found = np.zeros(len(self.prints), np.int64)
        while len(query):
            parts = []
            for cut in range(0, len(query), 20 * CHUNK):
                q, n = query[cut : cut + 20 * CHUNK], node[cut : cut + 20 * CHUNK]
                d = distance(self.prints[q], self.prints[n])
                hit = np.flatnonzero(d <= radius)
                if fits is not None:
                    hit = hit[fits(q[hit], n[hit])]
                yield q[hit], n[hit]
                np.add.at(found, q[hit], 1)
                which, child = self._children(n, d - radius, d + radius, least=0)
                before = child < q[which]
                parts.append((q[which][before], child[before]))
            query = np.concatenate([p[0] for p in parts])
            node = np.concatenate([p[1] for p in parts])
            still = found[query] < most
            query, node = query[still], node[still]


def components(n: int, pairs) -> np.ndarray:
    """Smallest index that each of n items reaches over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def spanning(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (print, other) that connect each bucket as its near pairs do."""
    if not len(prints):
        return prints, prints
    label = components(len(prints), Forest(bucket, prints).links(radius))
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]
