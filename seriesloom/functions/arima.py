"""Seasonal ARMA errors of many series at once: a search by conditional least squares, and the exact likelihood.

The exact likelihood comes from a Kalman filter whose state holds the ARMA part and, where months are missing, the last
levels that differencing needs, with a diffuse start. A missing month is a step without an update. Mean, drift and
regressors are not searched for: they pass the same filter, and generalised least squares gives their coefficients.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: variance of the unknown first levels, in units of the noise, and the share of it above which a step only finds them
DIFFUSE, FOUND = 1e7, 1e4
#: largest inverse root that counts as stable
EDGE = 0.995


@dataclass(frozen=True)
class Shape:
    """Places of the parameters: ``pq`` of AR, ``pq`` of MA, ``PQ`` of seasonal AR and ``PQ`` of seasonal MA, season ``m``."""

    pq: int
    PQ: int
    m: int

    @property
    def size(self) -> int:
        return 2 * (self.pq + self.PQ)

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(np.split(theta[:, : self.size], [self.pq, 2 * self.pq, 2 * self.pq + self.PQ], axis=1))

    def active(self, p: int, q: int, sp: int, sq: int) -> np.ndarray:
        if max(p, q) > self.pq or max(sp, sq) > self.PQ:
            raise ValueError(f"order ({p}, {q})({sp}, {sq}) is above ({self.pq})({self.PQ})")
        on = [np.arange(n) < k for n, k in ((self.pq, p), (self.pq, q), (self.PQ, sp), (self.PQ, sq))]
        return np.concatenate(on)

    def polynomials(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lag weights of the AR and the MA side, one row per candidate; lag 0 stays zero."""
        phi, ma, sphi, sma = self.parts(theta)
        out = []
        for short, long, sign in ((phi, sphi, -1.0), (ma, sma, 1.0)):
            w = np.zeros((len(theta), self.pq + self.m * self.PQ + 1))
            w[:, 1 : self.pq + 1] += short
            for j in range(1, self.PQ + 1):
                w[:, self.m * j] += long[:, j - 1]
                w[:, self.m * j + 1 : self.m * j + self.pq + 1] += sign * long[:, j - 1 : j] * short
            out.append(w)
        return out[0], out[1]

    def unstable(self, theta: np.ndarray) -> np.ndarray:
        """Rows whose AR or MA side has a root on or inside the unit circle."""
        phi, ma, sphi, sma = self.parts(theta)
        return np.any([outside_unit(c) for c in (phi, -ma, sphi, -sma)], axis=0)


def outside_unit(coefs: np.ndarray) -> np.ndarray:
    if coefs.shape[1] == 0:
        return np.zeros(len(coefs), bool)
    companion = np.zeros((len(coefs), coefs.shape[1], coefs.shape[1]))
    companion[:, 0, :] = coefs
    companion[:, np.arange(1, coefs.shape[1]), np.arange(coefs.shape[1] - 1)] = 1.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) >= EDGE


# --- least squares


def conditional_errors(w: np.ndarray, x: np.ndarray, theta: np.ndarray, shape: Shape) -> np.ndarray:
    """One-step errors for rows of equal length; values before the start count as zero. After the ARMA parameters come those of ``x``."""
    u = w - np.einsum("rk,rkt->rt", theta[:, shape.size :], x)
    ar, ma = shape.polynomials(theta)
    n = w.shape[1]
    v = u.copy()
    for j in range(1, ar.shape[1]):
        if j < n and np.any(ar[:, j]):
            v[:, j:] -= ar[:, j : j + 1] * u[:, : n - j]
    used = np.array([j for j in range(1, ma.shape[1]) if j < n and np.any(ma[:, j])], dtype=int)
    if not len(used):
        return v
    pad = ma.shape[1]
    e = np.zeros((n + pad, len(w)))
    weights = ma[:, used].T
    vt = v.T
    for t in range(n):
        e[t + pad] = vt[t] - (weights * e[t + pad - used]).sum(axis=0)
    return e[pad:].T


def least_squares(errors: Callable[[np.ndarray, np.ndarray], np.ndarray], theta: np.ndarray, active: np.ndarray, bounded: int, rounds: int = 12):
    """Damped Gauss-Newton for every row. ``errors(theta, rows)`` gives the errors of some rows; ``active`` marks the
    parameters of each row, of which the first ``bounded`` stay in the range of stable ones."""
    theta = theta.copy()
    rows, k = theta.shape
    every = np.arange(rows)
    damp = np.full(rows, 1e-3)
    eps = 1e-5
    with np.errstate(all="ignore"):
        e = errors(theta, every)
        sse = (e * e).sum(axis=1)
        for _ in range(rounds):
            jac = np.zeros((rows, e.shape[1], k))
            for j in range(k):
                on = np.nonzero(active[:, j])[0]
                if len(on):
                    moved = theta[on].copy()
                    moved[:, j] += eps
                    jac[on, :, j] = (errors(moved, on) - e[on]) / eps
            jac = np.nan_to_num(jac, nan=0.0, posinf=0.0, neginf=0.0)
            gram = np.einsum("rti,rtj->rij", jac, jac)
            diag = np.einsum("rii->ri", gram)
            ridge = np.where(active, damp[:, None] * diag + 1e-10 * (1 + diag), 1.0)
            step = np.linalg.solve(gram + ridge[:, :, None] * np.eye(k), -np.einsum("rti,rt->ri", jac, np.nan_to_num(e))[:, :, None])[:, :, 0]
            step = np.where(active, step, 0.0)
            step[:, :bounded] = np.clip(step[:, :bounded], -0.5, 0.5)
            trial = theta + step
            trial[:, :bounded] = np.clip(trial[:, :bounded], -1.98, 1.98)
            te = errors(trial, every)
            tsse = np.nan_to_num((te * te).sum(axis=1), nan=np.inf)
            better = tsse < sse
            gain = np.max(np.where(better, (sse - tsse) / np.maximum(sse, 1e-12), 0.0), initial=0.0)
            theta[better], e[better], sse[better] = trial[better], te[better], tsse[better]
            damp = np.where(better, damp * 0.2, damp * 8)
            if gain < 1e-7 and damp.min() > 1e-2:
                break
    return theta, e, sse


def conditional_fit(w: np.ndarray, x: np.ndarray, active: np.ndarray, shape: Shape):
    """Parameters, errors and their sum of squares from zero; ``active`` has the ARMA parameters and those of ``x``."""
    start = np.zeros(active.shape)
    return least_squares(lambda theta, rows: conditional_errors(w[rows], x[rows], theta, shape), start, active, shape.size)


# --- exact likelihood


def difference_weights(d: int, D: int, m: int) -> np.ndarray:
    """The weights of earlier levels in y(t) = w(t) + sum of weight(j) y(t - j)."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(D):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(m - 1), -1.0])
    return -poly[1:]


def mean_column(n: int, d: int, D: int, m: int) -> np.ndarray | None:
    """What is 1 after differencing, over n months; None where neither mean nor drift is in the model."""
    if d + D >= 2:
        return None
    return np.ones(n) if d + D == 0 else np.arange(n) / (m if D else 1.0)


class Filter:
    """Kalman filter of rows of equal length and differencing; ``data`` is (rows, 1 + regressors, months), NaN where missing."""

    def __init__(self, data: np.ndarray, shape: Shape, weights: np.ndarray):
        self.data, self.shape, self.weights = data, shape, weights
        # a month without a value has none in the regressors either
        self.seen = np.isfinite(data[:, 0, :])
        self.size = shape.pq + shape.m * shape.PQ + 1

    def run(self, theta: np.ndarray, rows: np.ndarray):
        """Innovations (rows, series, months) in units of their deviation, log variances, and the last predicted state."""
        data, seen, r, k = self.data[rows], self.seen[rows], self.size, len(self.weights)
        ar, ma = self.shape.polynomials(theta)
        b, width = len(rows), r + k
        step = np.zeros((b, width, width))
        step[:, :r, 0][:, : ar.shape[1] - 1] = ar[:, 1:]
        step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
        look = np.r_[1.0, np.zeros(r - 1), self.weights]
        if k:
            step[:, r, :] = look
            step[:, np.arange(r + 1, width), np.arange(r, width - 1)] = 1.0
        noise = np.zeros((b, width))
        noise[:, 0] = 1.0
        noise[:, 1:r][:, : ma.shape[1] - 1] = ma[:, 1:]
        shock = noise[:, :, None] * noise[:, None, :]
        # variance of the stationary part: doubling sums the series T^i V T'^i
        p, t = shock.copy(), step.copy()
        p[:, r:], p[:, :, r:], t[:, r:], t[:, :, r:] = 0.0, 0.0, 0.0, 0.0
        for _ in range(12):
            p = p + t @ p @ t.transpose(0, 2, 1)
            t = t @ t
        p[:, np.arange(r, width), np.arange(r, width)] = DIFFUSE
        a = np.zeros((b, width, data.shape[1]))
        v, logs = np.zeros(data.shape), np.zeros(seen.shape)
        used = np.zeros(seen.shape, bool)
        for at in range(data.shape[2]):
            on = seen[:, at]
            gain = p @ look
            f = gain @ look
            error = np.where(on[:, None], data[:, :, at] - np.einsum("s,bsc->bc", look, a), 0.0)
            used[:, at] = on & (f < FOUND if k else True)
            scale = np.where(used[:, at], 1.0 / np.sqrt(f), 0.0)
            v[:, :, at], logs[:, at] = error * scale[:, None], np.where(used[:, at], np.log(f), 0.0)
            share = np.where(on, 1.0 / f, 0.0)
            a = a + gain[:, :, None] * (error * share[:, None])[:, None, :]
            p = p - gain[:, :, None] * gain[:, None, :] * share[:, None, None]
            a, p = step @ a, step @ p @ step.transpose(0, 2, 1) + shock
        return v, logs, used, a, step, look

    def errors(self, theta: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Errors whose sum of squares is least where the likelihood is greatest (Ansley's scaling)."""
        v, logs, used, *_ = self.run(theta, rows)
        e = v[:, 0] - np.einsum("bct,bc->bt", v[:, 1:], coefficients(v))
        out = e * np.exp(logs.sum(1) / np.maximum(2 * used.sum(1), 1))[:, None]
        out[self.shape.unstable(theta)] = np.inf
        return out


def coefficients(v: np.ndarray) -> np.ndarray:
    """Generalised least squares of the filtered regressors."""
    x = v[:, 1:]
    if x.shape[1] == 0:
        return np.zeros((len(v), 0))
    gram = np.einsum("bct,bdt->bcd", x, x)
    size = np.einsum("bcc->bc", gram)
    return np.linalg.solve(gram + 1e-10 * (size + 1e-300)[:, :, None] * np.eye(x.shape[1]), np.einsum("bct,bt->bc", x, v[:, 0])[:, :, None])[:, :, 0]


def exact_fit(data: np.ndarray, theta: np.ndarray, active: np.ndarray, shape: Shape, weights: np.ndarray, ahead: np.ndarray, rounds: int = 12):
    """Maximum likelihood from a start: parameters, regressor coefficients, -2 log likelihood, errors used, forecasts, innovations.

    ``ahead`` has the regressors over the horizon, (rows, regressors, h). Rows that start unstable start from zero.
    """
    flt = Filter(data, shape, weights)
    start = np.where(shape.unstable(theta)[:, None], 0.0, theta)
    theta, _, _ = least_squares(flt.errors, start, active, shape.size, rounds)
    v, logs, used, a, step, look = flt.run(theta, np.arange(len(data)))
    beta = coefficients(v)
    e = v[:, 0] - np.einsum("bct,bc->bt", v[:, 1:], beta)
    n = used.sum(1)
    variance = np.maximum((e * e).sum(1) / np.maximum(n, 1), 1e-300)
    deviance = n * np.log(2 * np.pi * variance) + logs.sum(1) + n
    state = a[:, :, 0] - np.einsum("bsc,bc->bs", a[:, :, 1:], beta)
    out = np.empty((len(data), ahead.shape[2]))
    for i in range(ahead.shape[2]):
        out[:, i] = state @ look
        state = np.einsum("bij,bj->bi", step, state)
    innovations = np.where(used, e * np.exp(logs / 2), np.nan)
    return theta, beta, deviance, n, out + np.einsum("bct,bc->bt", ahead, beta), innovations
