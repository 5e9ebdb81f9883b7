"""Scoring queries against posting lists, with bounds that leave rows out early.

A shard holds, for each feature bucket, the numbers and weights of its rows. A query takes the
buckets in falling order of its own weights. What is left of a row's score is at most the length
of the query's remaining part times the length of the row's remaining part (rows have length one),
so rows that cannot reach the score to beat are dropped while lists are still unread. Many queries
at a time are scored by one product with the written-out rows in single precision, whose error is
bounded, and only pairs that may be good enough are scored again in full.
"""

from __future__ import annotations

import numpy as np

# How often the bounds are looked at, and the share of rows below which the rest is settled row by row.
STEP = 8
FEW = 8
# Queries of a product, more than a score of single precision may be off (rows and queries have length
# one; 512 products of 24 bits), and pairs that are scored in full at a time.
TOGETHER = 512
OFF = 1e-4
PAIRS = 8192


class Shard:
    """Posting lists of up to some thousand rows; ``lists`` maps a bucket to (row numbers, weights)."""

    def __init__(self, size: int, lists: dict[int, tuple[np.ndarray, np.ndarray]], dims: int):
        self.size, self.lists, self.dims = size, lists, dims
        self._rows: np.ndarray | None = None
        self._short: np.ndarray | None = None
        self.read = 0  # postings read so far

    def rows(self) -> np.ndarray:
        """Rows written out, made when rows are first settled one by one."""
        if self._rows is None:
            self._rows = np.zeros((self.size, self.dims))
            for bucket, (numbers, weights) in self.lists.items():
                self._rows[numbers, bucket] = weights
        return self._rows

    def best(self, buckets: np.ndarray, weights: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the best ``k`` rows with a positive score of at least ``bar``, ties by number."""
        order = np.argsort(-np.abs(weights), kind="stable")
        buckets, weights = buckets[order], weights[order]
        left = np.sqrt(np.maximum(0.0, np.append(np.cumsum(weights[::-1] ** 2)[::-1], 0.0)))
        score, rest = np.zeros(self.size), np.ones(self.size)
        bar = max(bar, 0.0)
        for at, (bucket, weight) in enumerate(zip(buckets.tolist(), weights.tolist(), strict=True)):
            if at % STEP == 0 and at:
                # Any k rows' scores so far, less what may still be taken from them, are beaten by the best k.
                reach = left[at] * np.sqrt(np.maximum(rest, 0.0)) + 1e-9
                if self.size > k:
                    low = np.partition(score - reach, self.size - k)[self.size - k]
                    bar = max(bar, round(low, 12) - 1e-9)
                alive = np.flatnonzero(score + reach >= bar)
                if len(alive) * FEW <= self.size:
                    return self._settled(alive, buckets, weights, k, bar)
            found = self.lists.get(bucket)
            if found is not None:
                numbers, own = found
                self.read += len(numbers)
                score[numbers] += weight * own
                rest[numbers] -= own * own
        return self._top(np.arange(self.size), score, k, bar)

    def best_of(self, queries: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`best` of many queries, written out one a row: places of the queries, numbers and scores."""
        rows = self.rows()
        if self._short is None:
            self._short = rows.astype(np.float32)
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for at in range(0, len(queries), TOGETHER):
            part, bar = queries[at : at + TOGETHER], np.maximum(bars[at : at + TOGETHER], 0.0)
            rough = part.astype(np.float32) @ self._short.T
            hit = rough >= (bar - OFF).astype(np.float32)[:, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
            if len(many) and self.size > k:
                own = rough[many]
                nth = np.partition(own, self.size - k, axis=1)[:, self.size - k]
                hit[many] &= own >= nth[:, None] - np.float32(2 * OFF)
            query, number = np.nonzero(hit)
            score = np.empty(len(query))
            for low in range(0, len(query), PAIRS):
                some = slice(low, low + PAIRS)
                score[some] = np.einsum("ij,ij->i", part[query[some]], rows[number[some]])
            score = np.round(np.clip(score, 0.0, 1.0), 12)
            fit = np.flatnonzero((score > 0) & (score >= bar[query]))
            fit = fit[np.lexsort((number[fit], -score[fit], query[fit]))]
            query, number, score = query[fit], number[fit], score[fit]
            first = np.arange(len(query)) - np.searchsorted(query, query) < k
            found.append((query[first] + at, number[first], score[first]))
        query, number, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return query, number, score

    def _settled(self, alive, buckets, weights, k, bar):
        query = np.zeros(self.dims)
        query[buckets] = weights
        return self._top(alive, self.rows()[alive] @ query, k, bar)

    def _top(self, numbers, score, k, bar):
        score = np.round(np.clip(score, 0.0, 1.0), 12)
        fit = np.flatnonzero((score > 0) & (score >= bar))
        first = fit[np.lexsort((numbers[fit], -score[fit]))[:k]]
        return numbers[first], score[first]
