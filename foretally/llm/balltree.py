"""Exact top inner products of sparse integer vectors by ball trees.

A tree halves its vectors again and again by a random sketch. For a block of queries, each node gets the centroid
of its vectors and a radius around it, both over the terms of these queries alone: no vector v of the node has a
larger product with a query q than q.centroid + |q| radius. Each query opens nodes best bound first and stops at
the first bound below its k-th score. Bounds are rounded up, so that floating point prunes nothing wrongly;
scores at the leaves are whole numbers and exact.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 64
_SKETCH = 16
_EXACT = float(1 << 53)
#: Relative slack of sums of up to 10**5 products in doubles, with room to spare; squares lose more by cancelling.
_SLACK, _SQUARE_SLACK = 1e-9, 1e-10


class Vectors:
    """Rows of (term, value) with whole values, the rows' parts one after the other."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.offsets, self.terms, self.values = offsets, terms, values
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def within(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place of the term in the sorted ``terms``, value) of the parts that have one of them."""
        place = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        held = np.flatnonzero(terms[place] == self.terms)
        return self.row[held], place[held], self.values[held]


def halved(vectors: Vectors, weights: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The rows of each leaf, in the order of a full binary tree of equal halves."""
    signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0]), (int(vectors.terms.max(initial=0)) + 1, _SKETCH))
    loads = vectors.values * weights[vectors.terms]
    sketch = np.stack([np.bincount(vectors.row, loads * signs[vectors.terms, k], len(vectors)) for k in range(_SKETCH)], axis=1)
    nodes = [np.arange(len(vectors))]
    while len(nodes[0]) > leaf:
        nodes = [half for rows in nodes for half in _halves(rows, sketch)]
    return nodes


def _halves(rows: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = sketch[rows]
    order = np.argsort(own[:, np.argmax(own.std(axis=0))], kind="stable")
    cut = (len(rows) + 1) // 2
    return rows[order[:cut]], rows[order[cut:]]


class Best:
    """The best ``k`` (score, id) of one query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this one, or below 1, can't get in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if not len(good):
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Tree:
    """A ball tree over some documents: ``ids`` names the rows of ``vectors``."""

    def __init__(self, ids: np.ndarray, vectors: Vectors, weights: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        self.leaves = halved(vectors, weights, leaf)

    def search(self, queries: Vectors, best: list[Best]) -> int:
        """Brings ``best``, one for each row of ``queries``, up to date; returns how many leaves were scored for a query."""
        terms = np.unique(queries.terms)
        if not len(terms) or not len(self.vectors):
            return 0
        row, place, value = self.vectors.within(terms)
        if not len(row):
            return 0
        asked = np.zeros((len(queries), len(terms)), np.int64)
        asked[queries.row, np.searchsorted(terms, queries.terms)] = queries.values
        bounds = self._bounds(asked.astype(np.float64), row, place, value)
        first_leaf, scored, opened = len(self.leaves) - 1, {}, 0
        starts = np.searchsorted(row, np.arange(len(self.vectors) + 1))
        largest = float(np.abs(asked).sum(axis=1).max()) * float(np.abs(value).max())
        for query, found in enumerate(best):
            frontier = [(-bounds[query, 0], 0)]
            while frontier:
                bound, node = heapq.heappop(frontier)
                if -bound < found.least:
                    break
                if node < first_leaf:
                    for child in (2 * node + 1, 2 * node + 2):
                        heapq.heappush(frontier, (max(bound, -bounds[query, child]), child))
                    continue
                rows = self.leaves[node - first_leaf]
                if node not in scored:
                    scored[node] = _products(asked, rows, starts, place, value, largest)
                found.add(scored[node][query], self.ids[rows])
                opened += 1
        return opened

    def _bounds(self, asked: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """An upper bound of each query's products in each node, the root first."""
        n_terms, value = asked.shape[1], value.astype(np.float64)
        lengths = np.bincount(row, value * value, len(self.vectors))
        norms = np.sqrt((asked * asked).sum(axis=1))[:, None]
        groups, levels = self.leaves, []
        while True:
            owner = np.empty(len(self.vectors), np.int64)
            for number, rows in enumerate(groups):
                owner[rows] = number
            counts = np.maximum(np.bincount(owner, minlength=len(groups)), 1)
            centroids = np.bincount(owner[row] * n_terms + place, value, len(groups) * n_terms).reshape(len(groups), n_terms) / counts[:, None]
            own = (centroids * centroids).sum(axis=1)
            across = np.bincount(row, value * centroids[owner[row], place], len(self.vectors))
            squares = lengths - 2 * across + own[owner] + _SQUARE_SLACK * (lengths + own[owner] + 1)
            radii = np.zeros(len(groups))
            np.maximum.at(radii, owner, np.sqrt(np.maximum(squares, 0)))
            levels.append((asked @ centroids.T + norms * radii) * (1 + _SLACK) + 1)
            if len(groups) == 1:
                return np.concatenate(levels[::-1], axis=1)
            groups = [np.concatenate(groups[i : i + 2]) for i in range(0, len(groups), 2)]


def _products(asked: np.ndarray, rows: np.ndarray, starts: np.ndarray, place: np.ndarray, value: np.ndarray, largest: float) -> np.ndarray:
    """Exact products of all queries with some rows; by floating point where whole numbers of this size are exact in it."""
    exact = largest < _EXACT
    held = np.zeros((len(rows), asked.shape[1]), np.float64 if exact else np.int64)
    for i, r in enumerate(rows.tolist()):
        a, b = starts[r], starts[r + 1]
        held[i, place[a:b]] = value[a:b]
    return (asked.astype(held.dtype) @ held.T).astype(np.int64)
