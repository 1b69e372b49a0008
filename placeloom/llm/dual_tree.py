"""Trees of sparse rows whose nodes hold coordinate maxima, and their search in pairs.

A node's maxima bound the score of every row below it; the union of the terms of some
items bounds that of each of them. So one sum over a node of items and a node of documents
bounds all their pairs, and where it stays below the weakest kth score of the items none
of the pairs can enter a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Documents of a lowest node, and children of the others.
RUN, FANOUT = 32, 8
# Questions that order rows, and the largest table of counts made to choose one.
_QUESTIONS, _COUNTS = 12, 1 << 21


@dataclass(frozen=True)
class Rows:
    """Sparse rows: row r has ``terms`` and ``values`` from ``starts[r]`` to ``starts[r + 1]``."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def sums(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each given row, which is not empty, the sum of weight times value, in whole numbers."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        heads = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[rows] - heads, lengths) + np.arange(lengths.sum())
        return np.add.reduceat(weights[self.terms[at]] * self.values[at], heads)

    def __len__(self) -> int:
        return len(self.starts) - 1


def rows_of(of: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> Rows:
    """From entries ordered by their row."""
    return Rows(np.searchsorted(of, np.arange(n + 1)), terms, values)


def order(of: np.ndarray, terms: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """The rows in an order that puts like ones together.

    Again and again the term is asked for that parts the groups so far most evenly.
    """
    group = np.zeros(n, np.int64)
    for _ in range(_QUESTIONS):
        n_groups = int(group.max(initial=0)) + 1
        if n_groups * n_terms > _COUNTS or n_groups >= n:
            break
        sizes = np.bincount(group, minlength=n_groups)
        counts = np.bincount(group[of] * n_terms + terms, minlength=n_groups * n_terms).reshape(n_groups, n_terms)
        best = int((counts * (sizes[:, None] - counts)).sum(axis=0).argmax())
        has = np.zeros(n, np.int64)
        has[of[terms == best]] = 1
        group = np.unique(group * 2 + has, return_inverse=True)[1]
    return np.argsort(group, kind="stable")


def maxima(rows: Rows, size: int, n_terms: int) -> Rows:
    """Nodes of ``size`` consecutive rows, with the largest value of each term."""
    node = np.repeat(np.arange(len(rows)), np.diff(rows.starts)) // size
    keys = node * n_terms + rows.terms
    by_key = np.argsort(keys, kind="stable")
    keys, values = keys[by_key], rows.values[by_key]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return rows_of(keys[heads] // n_terms, keys[heads] % n_terms, np.maximum.reduceat(values, heads), -(-len(rows) // size))


class DocumentTree:
    """``levels[0]`` the documents in tree order, each further level the nodes above."""

    def __init__(self, rows: Rows, n_terms: int):
        self.levels, size = [rows], RUN
        while len(self.levels) == 1 or len(self.levels[-1]) > 1:
            self.levels.append(maxima(self.levels[-1], size, n_terms))
            size = FANOUT

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        size = RUN if level == 1 else FANOUT
        below = (nodes[:, None] * size + np.arange(size)).ravel()
        return below[below < len(self.levels[level - 1])]


class ItemTree:
    """Items in tree order; a node of level l spans FANOUT ** l consecutive ones."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        """``items``: the terms of each, once; ``weights``: of every term, none negative."""
        of = np.repeat(np.arange(len(items)), [len(t) for t in items])
        terms = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.order = order(of, terms, len(items), len(weights))
        self.items = [items[i] for i in self.order]
        self.weights = weights
        self.top = 0
        while FANOUT**self.top < len(items):
            self.top += 1

    def span(self, level: int, node: int) -> tuple[int, int]:
        size = FANOUT**level
        return node * size, min((node + 1) * size, len(self.items))

    def node_weights(self, level: int, node: int) -> np.ndarray:
        """The largest weight of each term below a node."""
        start, end = self.span(level, node)
        found = np.zeros(len(self.weights), np.int64)
        for terms in self.items[start:end]:
            found[terms] = self.weights[terms]
        return found


class Best:
    """Of each item the best ``k`` rows met so far that beat its given bound.

    A row is a score and a document id; of equal scores the smaller id is better, and a
    null id comes last.
    """

    def __init__(self, n: int, k: int, bounds: dict[int, tuple[int, int, int]]):
        """``bounds``: (score, 1 if the id is null, id) of rows known to stand at place k."""
        self.k = k
        self.rows = [np.zeros((0, 3), np.int64) for _ in range(n)]
        self.score = np.zeros(n, np.int64)  # what a row must reach
        self.bound: list[tuple[int, int, int] | None] = [None] * n
        for item, bound in bounds.items():
            self._raise(item, bound)

    def _raise(self, item: int, bound: tuple[int, int, int]) -> None:
        self.bound[item], self.score[item] = bound, bound[0]

    def offer(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """``docs``: (1 if the id is null, id) of each scored row."""
        good = scores >= max(1, self.score[item])
        rows = np.column_stack([scores[good], docs[good]])
        if (bound := self.bound[item]) is not None:
            score, null, doc = bound
            ahead = (rows[:, 1] < null) | ((rows[:, 1] == null) & (rows[:, 2] < doc))
            rows = rows[(rows[:, 0] > score) | ahead]
        if not len(rows):
            return
        rows = np.concatenate([self.rows[item], rows])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]
        self.rows[item] = rows
        if len(rows) == self.k:
            self._raise(item, tuple(rows[-1].tolist()))


def search(documents: DocumentTree, docs: np.ndarray, items: ItemTree, best: Best) -> int:
    """Offer ``best`` every pair of an item and a document that may enter it; how many were scored.

    ``docs``: (1 if the id is null, id) of the documents in tree order.
    """
    scored = 0

    def visit(item_level: int, node: int, level: int, nodes: np.ndarray) -> None:
        nonlocal scored
        start, end = items.span(item_level, node)
        weights = items.node_weights(item_level, node)
        bounds = documents.levels[level].sums(nodes, weights)
        alive = bounds >= max(1, int(best.score[start:end].min()))
        nodes, bounds = nodes[alive], bounds[alive]
        if not len(nodes):
            return
        if item_level:
            below = documents.children(level, nodes) if level > 1 else nodes
            for child in range(node * FANOUT, min((node + 1) * FANOUT, -(-len(items.items) // FANOUT ** (item_level - 1)))):
                visit(item_level - 1, child, max(level - 1, 1), below)
        elif level > 1:
            visit(0, node, level - 1, documents.children(level, nodes))
        else:
            # The most promising nodes first: what they hold raises the bar for the others.
            ranked, at, size = np.argsort(-bounds, kind="stable"), 0, 4
            while at < len(ranked) and bounds[ranked[at]] >= best.score[node]:
                part = ranked[at : at + size]
                rows = documents.children(1, nodes[part[bounds[part] >= best.score[node]]])
                best.offer(node, documents.levels[0].sums(rows, weights), docs[rows])
                scored += len(rows)
                at, size = at + size, 2 * size

    if len(items.items) and len(documents.levels[0]):
        visit(items.top, 0, len(documents.levels) - 1, np.arange(len(documents.levels[-1])))
    return scored
