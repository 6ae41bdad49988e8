"""Numeric helpers that run inside tasks on a batch of short series.

Each helper fits one given form; the search over forms is done by Spark, which holds every
candidate as a row.
"""

from __future__ import annotations

import numpy as np

PENALTY = 1e12


def aicc(n: int, deviance: np.ndarray, p: np.ndarray | int) -> np.ndarray:
    """Corrected information criterion from n * log(mean squared error) or its analogue."""
    room = n - p - 1
    return np.where(room > 0, deviance + 2 * p + 2 * p * (p + 1) / np.maximum(room, 1), PENALTY)


# exponential smoothing


def ets_grid(trend: bool, season: bool, centre: tuple | None = None) -> np.ndarray:
    """Rows of (alpha, beta, gamma): a coarse grid, or a fine one around a found centre."""
    if centre is None:
        a = np.array([0.02, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
        bt = np.array([0.001, 0.02, 0.1, 0.3]) if trend else np.zeros(1)
        g = np.array([0.001, 0.05, 0.15, 0.35]) if season else np.zeros(1)
    else:
        spread = np.array([0.6, 0.8, 1.0, 1.25, 1.6])
        a = np.clip(centre[0] * spread, 1e-3, 1.0)
        bt = np.clip(centre[1] * spread, 1e-4, 1.0) if trend else np.zeros(1)
        g = np.clip(centre[2] * spread, 1e-4, 1.0) if season else np.zeros(1)
    grid = np.array(np.meshgrid(a, bt, g, indexing="ij")).reshape(3, -1).T
    # smoothing of trend and season cannot exceed that of the level
    return grid[(grid[:, 1] <= grid[:, 0]) & (grid[:, 2] <= 1 - grid[:, 0] + 1e-9)]


def ets_start(y: np.ndarray, m: int, trend: bool, season: str):
    """Level, slope and season before the first observation, for series as rows."""
    k = min(m, y.shape[1])
    first = y[:, :k].mean(axis=1)
    slope = np.zeros(len(y))
    if trend and y.shape[1] >= 2 * m:
        slope = (y[:, m : 2 * m].mean(axis=1) - first) / m
    elif trend:
        slope = (y[:, -1] - y[:, 0]) / max(y.shape[1] - 1, 1)
    level = first - slope * (k + 1) / 2
    line = level[:, None] + slope[:, None] * np.arange(1, m + 1)
    if season == "A":
        s = y[:, :m] - line
    elif season == "M":
        s = y[:, :m] / np.where(np.abs(line) > 1e-9, line, 1.0)
    else:
        s = np.zeros((len(y), 1))
    return level, slope, s


def ets_fold(y: np.ndarray, m: int, trend: bool, season: str, phi: float, grid: np.ndarray, h: int = 0):
    """Run the smoothing recursion for all series and parameter rows at once.

    Returns the deviance under additive and under multiplicative errors, the forecasts and
    the one-step errors of every (series, parameters).
    """
    alpha, beta, gamma = (grid[:, i][None, :] for i in range(3))
    level, slope, s0 = ets_start(y, m, trend, season)
    shape = (len(y), len(grid))
    l, b = np.broadcast_to(level[:, None], shape).copy(), np.broadcast_to(slope[:, None], shape).copy()
    s = [np.broadcast_to(s0[:, i : i + 1], shape).copy() for i in range(s0.shape[1])]
    n = y.shape[1]
    sse, rel, logs = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    errors = np.empty((*shape, n)) if h else None
    for t in range(n):
        base = l + phi * b
        si = s[t % m] if season != "N" else 0.0
        f = base * si if season == "M" else base + si
        e = y[:, t : t + 1] - f
        sse += e * e
        safe = np.where(np.abs(f) > 1e-9, np.abs(f), 1e-9)
        rel += (e / safe) ** 2
        logs += np.log(safe)
        step = e / np.where(np.abs(si) > 1e-9, si, 1e-9) if season == "M" else e
        l = base + alpha * step
        b = phi * b + beta * step
        if season == "A":
            s[t % m] = si + gamma * e
        elif season == "M":
            s[t % m] = si + gamma * e / np.where(np.abs(base) > 1e-9, base, 1e-9)
        if h:
            errors[:, :, t] = e
    ahead = np.empty((*shape, h))
    damp = np.zeros(shape)
    for k in range(h):
        damp = damp + phi ** (k + 1)
        base = l + damp * b
        if season == "N":
            ahead[:, :, k] = base
        else:
            si = s[(n + k) % m]
            ahead[:, :, k] = base * si if season == "M" else base + si
    tiny = 1e-12
    return n * np.log(sse / n + tiny), n * np.log(rel / n + tiny) + 2 * logs, ahead, errors


def ets_fit(y: np.ndarray, m: int, error: str, trend: str, season: str, phi: float, h: int):
    """Best smoothing parameters of one form for series as rows: aicc, parameters, forecasts, errors."""
    has_trend, has_season = trend != "N", season != "N"
    pick = (lambda r: r[0]) if error == "A" else (lambda r: r[1])
    grid = ets_grid(has_trend, has_season)
    with np.errstate(all="ignore"):
        score = pick(ets_fold(y, m, has_trend, season, phi, grid))
        coarse = grid[np.argmin(np.nan_to_num(score, nan=PENALTY), axis=1)]
        out = []
        for row, centre in zip(y, coarse):
            fine = np.vstack([ets_grid(has_trend, has_season, tuple(centre)), centre])
            result = ets_fold(row[None, :], m, has_trend, season, phi, fine)
            best = fine[[int(np.argmin(np.nan_to_num(pick(result)[0], nan=PENALTY)))]]
            result = ets_fold(row[None, :], m, has_trend, season, phi, best, h)
            p = 2 + has_trend * 2 + (trend == "D") + has_season * m + 1
            out.append((float(aicc(len(row), pick(result)[0, 0], p)), [*best[0].tolist(), phi], result[2][0, 0], result[3][0, 0]))
    return out


# differencing


def kpss_level(y: np.ndarray) -> float:
    """KPSS statistic for stationarity around a level."""
    n = len(y)
    e = y - y.mean()
    lags = int(3 * np.sqrt(n) / 13)
    var = e @ e / n
    for k in range(1, lags + 1):
        var += 2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n
    s = np.cumsum(e)
    return float(s @ s / (n * n * var)) if var > 1e-12 else 0.0


def seasonal_strength(y: np.ndarray, m: int) -> float:
    """1 - var(remainder) / var(season + remainder) after a centred moving average."""
    if len(y) < 2 * m + 2:
        return 0.0
    kernel = np.r_[0.5, np.ones(m - 1), 0.5] / m
    detrended = y[m // 2 : len(y) - m // 2] - np.convolve(y, kernel, "valid")
    month = (np.arange(len(detrended)) + m // 2) % m
    effect = np.array([detrended[month == k].mean() for k in range(m)])
    rest = detrended - effect[month]
    whole = detrended.var()
    return float(max(0.0, 1 - rest.var() / whole)) if whole > 1e-12 else 0.0


def differences(y: np.ndarray, m: int) -> tuple[int, int]:
    """Ordinary and seasonal differences a series needs."""
    D = int(seasonal_strength(y, m) > 0.64)
    w = y[m:] - y[:-m] if D else y
    d = 0
    # 0.463: fixed value, 5 % point of the KPSS level statistic
    while d < 2 - D and len(w) > 8 and kpss_level(w) > 0.463:
        w, d = np.diff(w), d + 1
    return d, D


def difference(y: np.ndarray, d: int, D: int, m: int) -> np.ndarray:
    for _ in range(D):
        y = y[m:] - y[:-m]
    for _ in range(d):
        y = np.diff(y)
    return y


def undifference(y: np.ndarray, ahead: np.ndarray, d: int, D: int, m: int) -> np.ndarray:
    """Add the differences back, starting from the end of the series."""
    levels = [y]
    for _ in range(D):
        levels.append(levels[-1][m:] - levels[-1][:-m])
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    for i in range(d):
        ahead = levels[-2 - i][-1] + np.cumsum(ahead)
    for i in range(D):
        past = list(levels[D - 1 - i])
        for v in ahead:
            past.append(v + past[-m])
        ahead = np.array(past[-len(ahead) :]) if len(ahead) else ahead
    return ahead


# trend with change points and yearly Fourier terms


def trend_season_design(t: np.ndarray, knots: np.ndarray, season: np.ndarray, order: int, m: int) -> np.ndarray:
    cols = [np.ones_like(t), t]
    cols += [np.maximum(t - k, 0.0) for k in knots]
    for k in range(1, order + 1):
        cols += [np.sin(2 * np.pi * k * season / m), np.cos(2 * np.pi * k * season / m)]
    return np.column_stack(cols)


def trend_season_fit(y: np.ndarray, x: np.ndarray, h: int, m: int = 12, order: int = 5, n_knots: int = 25):
    """Ridge fit of one series; ``x`` holds regressors for its history and horizon as rows.

    Returns forecasts, one-step errors and coefficients.
    """
    n = len(y)
    scale = float(np.abs(y).max()) or 1.0
    t = np.arange(n + h) / max(n - 1, 1)
    order = min(order, max((n - 4) // 4, 0), m // 2)
    n_knots = min(n_knots, max(n // 3 - 1, 0))
    knots = np.linspace(0, 0.8, n_knots + 1)[1:] if n_knots else np.empty(0)
    season = np.arange(n + h, dtype=float)
    full = np.column_stack([trend_season_design(t, knots, season, order, m), x.T])
    z = y / scale
    plain = np.delete(full[:n], np.s_[2 : 2 + len(knots)], axis=1)
    rest = z - plain @ np.linalg.lstsq(plain, z, rcond=None)[0]
    noise = float(rest @ rest) / max(n - plain.shape[1], 1)
    # prior widths: 0.05 for change points, 10 for season and regressors; fixed values
    ridge = np.full(full.shape[1], noise / 100 + 1e-10)
    ridge[:2] = 1e-12
    ridge[2 : 2 + len(knots)] = noise / 0.0025 + 1e-8
    train = full[:n]
    beta = np.linalg.solve(train.T @ train + np.diag(ridge), train.T @ z)
    fitted = full @ beta * scale
    return fitted[n:], y - fitted[:n], beta


# trigonometric exponential smoothing


def box_cox(y: np.ndarray, lam: float) -> np.ndarray:
    return np.log(y) if lam == 0 else (y**lam - 1) / lam


def inverse_box_cox(z: np.ndarray, lam: float) -> np.ndarray:
    return np.exp(z) if lam == 0 else np.maximum(z * lam + 1, 0.0) ** (1 / lam)


def tbats_grid(phi: float, k: int, arma: bool) -> np.ndarray:
    """Rows of (alpha, beta, gamma1, gamma2, ar, ma)."""
    a = [0.02, 0.1, 0.25, 0.5, 0.8]
    b = [0.001, 0.05] if phi else [0.0]
    g = [0.001, 0.02] if k else [0.0]
    r = [-0.4, 0.4] if arma else [0.0]
    return np.array(np.meshgrid(a, b, g, g, r, r, indexing="ij")).reshape(6, -1).T


def tbats_fold(z: np.ndarray, m: int, phi: float, k: int, grid: np.ndarray, h: int):
    """Innovations recursion for all series and parameter rows: squared error, forecasts, errors."""
    shape = (len(z), len(grid))
    alpha, beta, g1, g2, ar, ma = (grid[:, i][None, :] for i in range(6))
    n = z.shape[1]
    t = np.arange(n)
    cols = [np.ones(n)] + ([t] if phi else [])
    waves = [2 * np.pi * j / m for j in range(1, k + 1)]
    for w in waves:
        cols += [np.cos(w * t), np.sin(w * t)]
    # seasonal start values from a regression on the whole series
    start = np.linalg.lstsq(np.column_stack(cols), z.T, rcond=None)[0].T
    at = 2 if phi else 1
    level = np.broadcast_to(start[:, :1], shape).copy()
    slope = np.broadcast_to(start[:, 1:2] if phi else np.zeros((len(z), 1)), shape).copy()
    level -= phi * slope
    s = [np.broadcast_to(start[:, at + 2 * j : at + 2 * j + 1], shape).copy() for j in range(k)]
    c = [np.broadcast_to(start[:, at + 2 * j + 1 : at + 2 * j + 2], shape).copy() for j in range(k)]
    d_prev, e_prev, sse = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    errors, ahead = np.empty((*shape, n)), np.empty((*shape, h))
    for step in range(n + h):
        d_hat = ar * d_prev + ma * e_prev
        base = level + phi * slope
        f = base + sum(s, np.zeros(shape)) + d_hat
        if step < n:
            e = z[:, step : step + 1] - f
            errors[:, :, step] = e
            sse += e * e
        else:
            e = np.zeros(shape)
            ahead[:, :, step - n] = f
        d = d_hat + e
        level, slope = base + alpha * d, phi * slope + beta * d
        for j, w in enumerate(waves):
            s[j], c[j] = np.cos(w) * s[j] + np.sin(w) * c[j] + g1 * d, -np.sin(w) * s[j] + np.cos(w) * c[j] + g2 * d
        d_prev, e_prev = d, e
    return sse, ahead, errors


def tbats_fit(y: np.ndarray, m: int, lam: float, phi: float, k: int, arma: bool, h: int):
    """Best smoothing parameters of one option set for series as rows."""
    grid = tbats_grid(phi, k, arma)
    n = y.shape[1]
    z = box_cox(y, lam)
    # the transform's Jacobian makes criteria comparable across lambdas
    jacobian = -2 * (lam - 1) * np.log(np.maximum(y, 1e-9)).sum(axis=1) if lam != 1 else np.zeros(len(y))
    p = 2 + 2 * (phi > 0) + (0 < phi < 1) + (2 + 2 * k) * (k > 0) + 2 * arma + (lam != 1)
    with np.errstate(all="ignore"):
        sse = np.nan_to_num(tbats_fold(z, m, phi, k, grid, 0)[0], nan=np.inf)
        best = grid[np.argmin(sse, axis=1)]
        out = []
        for row, b, jac in zip(z, best, jacobian):
            fine = b * np.array([0.7, 1.0, 1.4])[:, None]
            trial = np.vstack([np.column_stack([fine[i, 0] * np.ones(3), fine[:, 1], np.repeat(b[None, 2:], 3, axis=0)]) for i in range(3)])
            trial[:, 0] = np.clip(trial[:, 0], 1e-3, 1.0)
            sse, ahead, errors = tbats_fold(row[None, :], m, phi, k, trial, h)
            i = int(np.argmin(np.nan_to_num(sse[0], nan=np.inf)))
            score = float(aicc(n, n * np.log(sse[0, i] / n + 1e-14) + jac, p))
            back = inverse_box_cox(row, lam) - inverse_box_cox(row - errors[0, i], lam)
            out.append((score, [*trial[i].tolist(), lam, phi, k], inverse_box_cox(ahead[0, i], lam), back))
    return out
