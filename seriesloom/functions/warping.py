"""Nearest series under dynamic time warping without comparing all pairs in full.

A lower bound from envelopes (the least and largest value within the window) rules out most pairs. The rest are compared
diagonal by diagonal, many pairs at a time, and a pair is given up as soon as what it has cost and what it must still cost
exceed its limit. Results are those of the full recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: pairs that are compared at once, at most
AT_ONCE = 4096


@dataclass
class Counter:
    """Pairs of a search: all, those that the bound leaves, and those whose recursion ran to its end."""

    pairs: int = 0
    bounded: int = 0
    finished: int = 0


@dataclass
class Warping:
    """Absolute cost; ``window`` is the half width of the band (None: no band), ``diagonal`` the weight of a diagonal step."""

    window: int | None = None
    diagonal: float = 2.0
    counter: Counter = field(default_factory=Counter)

    def envelopes(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = y.shape[1]
        if self.window is None or self.window >= t:
            return np.broadcast_to(y.min(1)[:, None], y.shape), np.broadcast_to(y.max(1)[:, None], y.shape)
        wide = np.pad(y, ((0, 0), (self.window, self.window)), mode="edge")
        view = np.lib.stride_tricks.sliding_window_view(wide, 2 * self.window + 1, axis=1)
        return view.min(2), view.max(2)

    def _outside(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(x - high, low - x), 0.0)

    def _together(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """A path passes each row and each column. A straight step passes one of them at weight 1, a diagonal step both."""
        return np.maximum(np.maximum(rows, columns) * min(1.0, self.diagonal), (rows + columns) * min(1.0, self.diagonal / 2))

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A value that no distance between a row of ``x`` and a row of ``y`` is below."""
        (low_x, high_x), (low_y, high_y) = self.envelopes(x), self.envelopes(y)
        out = np.empty((len(x), len(y)))
        for i in range(len(x)):
            rows = self._outside(x[i], low_y, high_y)[:, 1:].sum(1)
            columns = self._outside(y, low_x[i], high_x[i])[:, 1:].sum(1)
            # the first cell costs once, whatever the weight of a diagonal step
            out[i] = np.abs(x[i, 0] - y[:, 0]) + self._together(rows, columns)
        # a hair below, since sums in another order round differently
        return out * (1 - 1e-12)

    def exact(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Distances of the pairs (x[p], y[p]); infinity for a pair that is above its limit and was given up."""
        p, t = x.shape
        band = t if self.window is None else self.window
        (low_x, high_x), (low_y, high_y) = self.envelopes(x), self.envelopes(y)
        # what rows and columns after a place must still cost
        tail = lambda outside: np.concatenate([np.cumsum(outside[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(outside), 1))], axis=1)
        rest_x, rest_y = tail(self._outside(x, low_y, high_y)), tail(self._outside(y, low_x, high_x))
        out = np.full(p, np.inf)
        alive = np.arange(p)
        before = np.full((p, t + 1), np.inf)  # column j at place j + 1
        last = np.full((p, t + 1), np.inf)
        reversed_x, rest_x = x[:, ::-1], rest_x[:, ::-1]
        for k in range(2 * t - 1):
            # cells (k - j, j) inside the matrix and the band
            low, high = max(0, k - t + 1, -((band - k) // 2)), min(k, t - 1, (k + band) // 2)
            now = np.full((len(alive), t + 1), np.inf)
            if low <= high:
                a = slice(t - 1 - k + low, t - k + high)
                cost = np.abs(reversed_x[:, a] - y[:, low : high + 1])
                if k == 0:
                    now[:, 1:2] = cost
                else:
                    straight = np.minimum(last[:, low + 1 : high + 2], last[:, low : high + 1]) + cost
                    now[:, low + 1 : high + 2] = np.minimum(straight, before[:, low : high + 1] + self.diagonal * cost)
            before, last = last, now
            if k % 4 == 3 and k < 2 * t - 2:
                # a path passes this diagonal or the one before; what it has cost there and must still cost is above the limit
                least = np.full(len(alive), np.inf)
                for d, cells in ((k, last), (k - 1, before)):
                    a, b = max(0, d - t + 1), min(d, t - 1)
                    still = self._together(rest_x[:, t - 1 - d + a : t - d + b], rest_y[:, a : b + 1])
                    least = np.minimum(least, (cells[:, a + 1 : b + 2] + still * (1 - 1e-12)).min(1))
                keep = least <= limit[alive]
                if keep.mean() < 0.8:
                    alive, before, last = alive[keep], before[keep], last[keep]
                    reversed_x, y, rest_x, rest_y = reversed_x[keep], y[keep], rest_x[keep], rest_y[keep]
                    if not len(alive):
                        break
        if len(alive):
            out[alive] = last[:, t]
            self.counter.finished += len(alive)
        return out

    def _distances(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for a in range(0, len(i), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            out[part] = self.exact(x[i[part]], y[j[part]], limit[part])
        return out

    def within(self, x: np.ndarray, y: np.ndarray, allowed: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The allowed pairs at a distance of at most ``eps``: places in x, places in y, distances."""
        i, j = np.nonzero(allowed & (self.bound(x, y) <= eps))
        self.counter.pairs += int(allowed.sum())
        self.counter.bounded += len(i)
        d = self._distances(x, y, i, j, np.full(len(i), eps))
        return i[d <= eps], j[d <= eps], d[d <= eps]

    def nearest(self, x: np.ndarray, y: np.ndarray, allowed: np.ndarray, k: int, limit_x: np.ndarray, limit_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs among which are the k nearest of each row of x and of each row of y, as far as they are within the limits."""
        low = np.where(allowed, self.bound(x, y), np.inf)
        limit_x, limit_y = limit_x.copy(), limit_y.copy()
        found = np.full(low.shape, np.inf)
        open_ = np.isfinite(low)
        self.counter.pairs += int(open_.sum())
        # the k nearest by the bound first, so that the limits are low for the rest
        first = np.zeros_like(open_)
        if low.size:
            np.put_along_axis(first, low.argpartition(min(k, low.shape[1] - 1), axis=1)[:, :k], True, axis=1)
            columns = low.argpartition(min(k, low.shape[0] - 1), axis=0)[:k]
            np.put_along_axis(first, columns, True, axis=0)
        turn = open_ & first
        while True:
            limit = np.maximum(limit_x[:, None], limit_y[None, :])
            i, j = np.nonzero(turn & (low <= limit))
            open_ &= ~turn
            if len(i):
                self.counter.bounded += len(i)
                found[i, j] = self._distances(x, y, i, j, limit[i, j])
                if found.shape[1] >= k:
                    limit_x = np.minimum(limit_x, np.partition(found, k - 1, axis=1)[:, k - 1])
                if found.shape[0] >= k:
                    limit_y = np.minimum(limit_y, np.partition(found, k - 1, axis=0)[k - 1])
            open_ &= low <= np.maximum(limit_x[:, None], limit_y[None, :])
            left = low[open_]
            if not len(left):
                break
            turn = open_ & (low <= np.partition(left, min(AT_ONCE, len(left)) - 1)[min(AT_ONCE, len(left)) - 1])
        i, j = np.nonzero(np.isfinite(found))
        keep = found[i, j] <= np.maximum(limit_x[i], limit_y[j])
        return i[keep], j[keep], found[i, j][keep]
