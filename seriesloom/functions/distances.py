"""Distances between two blocks of series, one row per series; each returns a matrix."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


# the share of the squares below which their difference has lost too many digits
CANCELLED = 1e-3


def euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By one matrix product of the squares; where these cancel, by the differences themselves."""
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    out = x @ y.T
    out *= -2
    out += a[:, None]
    out += b
    # comparisons that a NaN fails as well
    near = ~(out.min(axis=1, initial=np.inf) > CANCELLED * (a + b.max(initial=0.0)))
    for i in np.nonzero(near)[0]:
        j = np.nonzero(~(out[i] > CANCELLED * (a[i] + b)))[0]
        d = y[j] - x[i]
        out[i, j] = np.einsum("ij,ij->i", d, d)
    return np.sqrt(out, out=out)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.vstack([np.abs(y - row).sum(axis=1) for row in x])


def dtw(window: int | None = None, diagonal: float = 2.0) -> Kernel:
    """Dynamic time warping with absolute cost.

    ``window`` is the Sakoe-Chiba half width, widened to the difference of the lengths;
    ``diagonal`` is the weight of a diagonal step (2 = symmetric2, 1 = symmetric1).
    """

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, t = x.shape
        m, u = y.shape
        band = max(t, u) if window is None else max(window, abs(t - u))
        xt, yt = x.T[:, :, None], y.T[:, None, :]
        prev = np.full((u + 1, n, m), np.inf)
        prev[0] = 0.0
        for i in range(1, t + 1):
            cur = np.full((u + 1, n, m), np.inf)
            for j in range(max(1, i - band), min(u, i + band) + 1):
                cost = np.abs(xt[i - 1] - yt[j - 1])
                if i == 1 and j == 1:
                    cur[j] = cost
                    continue
                straight = np.minimum(prev[j] if i > 1 else np.inf, cur[j - 1])
                diag = prev[j - 1] + diagonal * cost if i > 1 and j > 1 else np.inf
                cur[j] = np.minimum(straight + cost, diag)
            prev = cur
        return prev[u]

    return kernel


def chi2_sf(x: np.ndarray, k: int) -> np.ndarray:
    """Upper tail of the chi-square distribution."""
    half = x / 2
    if k % 2 == 0:
        powers, out = [float(i) for i in range(k // 2)], np.zeros_like(half)
    else:
        powers, out = [i + 0.5 for i in range(k // 2)], np.vectorize(math.erfc, otypes=[float])(np.sqrt(half))
    for p in powers:
        out = out + np.exp(-half) * half**p / math.gamma(p + 1)
    return np.clip(out, 0.0, 1.0)


def ar_wald(k: int) -> Kernel:
    """p-value of equal AR coefficients; a row holds k coefficients and their k x k covariance."""

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(y)))
        for i, row in enumerate(x):
            d = y[:, :k] - row[:k]
            v = (y[:, k:] + row[k:]).reshape(len(y), k, k)
            stat = np.einsum("ij,ij->i", d, np.linalg.solve(v, d[:, :, None])[:, :, 0])
            out[i] = chi2_sf(np.maximum(stat, 0.0), k)
        return out

    return kernel


def likelihood_ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Symmetric divergence of log spectra, summed over the frequencies."""
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        r = row - y
        # log((f/g + 1) / 2) - log(f/g) / 2, the same for g/f
        out[i] = (np.logaddexp(r, 0.0) - np.log(2.0) - r / 2).mean(axis=1) * 2
    return out


# per-series features that the distances compare


def integrated_periodogram(a: np.ndarray) -> np.ndarray:
    n = len(a)
    power = np.abs(np.fft.fft(a - a.mean())[1 : n // 2 + 1]) ** 2
    whole = power.sum()
    return np.cumsum(power) / whole if whole > 0 else np.zeros_like(power)


def log_spectrum(a: np.ndarray, points: int) -> np.ndarray:
    """Log periodogram, smoothed by a local line and read at equally spaced frequencies."""
    n = len(a)
    power = np.abs(np.fft.fft(a - a.mean())[1 : n // 2 + 1]) ** 2 / n
    freq = np.arange(1, len(power) + 1) / n
    # 0.57721: fixed value, Euler's constant, the mean bias of a log periodogram
    logs = np.log(power + 1e-12) + 0.57721
    width = max(4.0 / n, 0.15 * freq[-1])
    out = np.empty(points)
    for i, f in enumerate(np.linspace(freq[0], freq[-1], points)):
        d = freq - f
        w = np.maximum(1 - (d / width) ** 2, 0.0)
        s0, s1, s2 = w.sum(), w @ d, w @ (d * d)
        det = s0 * s2 - s1 * s1
        out[i] = (s2 * (w @ logs) - s1 * (w @ (d * logs))) / det if det > 1e-12 else (w @ logs) / s0
    return out


def ar_order(a: np.ndarray, highest: int) -> int:
    """AR order with the lowest AIC."""
    scores = []
    for k in range(1, highest + 1):
        _, _, var, n = ar_regression(a, k)
        scores.append(n * np.log(var + 1e-14) + 2 * k)
    return int(np.argmin(scores)) + 1


def ar_regression(a: np.ndarray, k: int):
    """Least squares AR(k): coefficients, their covariance, error variance, rows used."""
    z = a - a.mean()
    x = np.column_stack([z[k - j - 1 : len(z) - j - 1] for j in range(k)])
    y = z[k:]
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    var = float(e @ e) / max(len(y) - k, 1)
    return beta, inverse * var, var, len(y)


def ar_features(a: np.ndarray, k: int) -> np.ndarray:
    beta, cov, _, _ = ar_regression(a, k)
    return np.concatenate([beta, (cov + 1e-12 * np.eye(k)).ravel()])


def window_statistic(e: np.ndarray, window: int) -> np.ndarray:
    """Between-window minus within-window variance of residual rows."""
    n = e.shape[1]
    blocks = np.lib.stride_tricks.sliding_window_view(e, window, axis=1)
    mean = blocks.mean(axis=2)
    between = window / (n - 1) * ((mean - mean.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    within = ((blocks - mean[:, :, None]) ** 2).sum(axis=(1, 2)) / (n * (window - 1))
    return np.sqrt(n) * (between - within)


def difference_ar1(e: np.ndarray) -> float:
    """AR(1) coefficient from differences (Hall and Van Keilegom), which a leftover trend hardly moves."""
    n = len(e)
    half_square = lambda m: float(((e[m:] - e[:-m]) ** 2).mean()) / 2
    lags = range(max(1, round(n**0.1)), max(2, round(n**0.5)) + 1)
    var = float(np.mean([half_square(m) for m in lags]))
    return float(np.clip((var - half_square(1)) / var, -0.99, 0.99)) if var > 0 else 0.0
