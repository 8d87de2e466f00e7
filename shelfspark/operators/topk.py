"""The k best rows for each of many queries, kept while batches pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class TopK:
    """Scores and paths of the k best rows of each query, by score and then path."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.paths = np.full((queries, k), None, object)

    def least(self) -> np.ndarray:
        """The k-th score of each query; -inf while it has fewer rows."""
        return self.scores[:, -1]

    def add(self, which: np.ndarray, scores: np.ndarray, paths: Callable[[np.ndarray], np.ndarray]) -> None:
        """Offer a block: ``scores`` has a row for each of the queries ``which``; ``paths`` names columns of it."""
        if not scores.size:
            return
        better = scores.max(axis=1) >= self.scores[which, -1]
        which, scores = which[better], scores[better]
        if not len(which):
            return
        k, n = self.k, scores.shape[1]
        tied: list[int] = []
        if n > k:
            at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(scores, at, axis=1)
            last = best.min(axis=1, keepdims=True)
            tied = np.flatnonzero((scores == last).sum(axis=1) > (best == last).sum(axis=1)).tolist()
        else:
            at, best = np.broadcast_to(np.arange(n), scores.shape), scores
        names, back = np.unique(at, return_inverse=True)
        found = paths(names)[back.reshape(at.shape)]
        both = np.concatenate([self.scores[which], best], axis=1)
        own = np.concatenate([self.paths[which], found], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : k + 1]
        self.scores[which] = np.take_along_axis(both, order[:, :k], axis=1)
        self.paths[which] = np.take_along_axis(own, order[:, :k], axis=1)
        top = np.take_along_axis(both, order, axis=1)
        equal = ((top[:, 1:] == top[:, :-1]) & np.isfinite(top[:, 1:])).any(axis=1)
        for i in sorted({*np.flatnonzero(equal).tolist(), *tied}):  # equal scores go by path
            values, spelt = both[i], own[i]
            if i in tied:  # the block has more rows of its k-th score than were taken
                more = np.flatnonzero(scores[i] >= last[i, 0])
                values, spelt = np.concatenate([both[i, :k], scores[i, more]]), np.concatenate([own[i, :k], paths(more)])
            some = np.flatnonzero(np.isfinite(values))
            first = some[np.lexsort((spelt[some].astype(str), -values[some]))[:k]]
            self.scores[which[i], : len(first)], self.paths[which[i], : len(first)] = values[first], spelt[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, path and score of all that is held."""
        at = np.nonzero(np.isfinite(self.scores))
        return at[0], self.paths[at], self.scores[at]
