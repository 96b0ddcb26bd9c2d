"""Unit-root test arithmetic on small per-pair matrices, and the p-value response surface."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon response-surface coefficients for a constant-only regression, by number
# of variables: switch point, lower and upper limits, coefficients below and above the switch.
RESPONSE_SURFACE = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def p_value(stat: float, n_vars: int = 1) -> float:
    """Probability of a statistic this low under a unit root."""
    switch, low, high, below, above = RESPONSE_SURFACE[n_vars]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    powers = below if stat <= switch else above
    z = sum(c * stat**k for k, c in enumerate(powers))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def max_lag(n: int, constant: bool) -> int:
    """Longest lag considered for ``n`` observations; below zero means too few rows."""
    return min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - (2 if constant else 1))


def design(values: np.ndarray, lags: int, first: int, constant: bool) -> np.ndarray:
    """Rows ``[1?, level, d(-1) .. d(-lags), d]`` for the changes into ``values[first:]``."""
    d = np.diff(values)
    at = np.arange(first, len(values))
    cols = [np.ones(len(at))] if constant else []
    cols.append(values[at - 1])
    cols += [d[at - 1 - k] for k in range(1, lags + 1)]
    cols.append(d[at - 1])
    return np.column_stack(cols)


def triangle(rows: np.ndarray) -> np.ndarray:
    """Triangular factor that stands for ``rows`` in any later least-squares fit."""
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))
    if r.shape[0] < width:
        r = np.vstack([r, np.zeros((width - r.shape[0], width))])
    return r


def choose_lag(r: np.ndarray, n: int, constant: bool) -> int:
    """Lag with the lowest AIC; each candidate is a leading part of the same triangle."""
    base = 2 if constant else 1
    rhs = r[:, -1]
    best, best_aic = 0, math.inf
    for lag in range(r.shape[1] - 1 - base + 1):
        k = base + lag
        ssr = float(rhs[k:] @ rhs[k:])
        aic = -math.inf if ssr <= 0 else n * (math.log(2 * math.pi * ssr / n) + 1) + 2 * k
        if aic < best_aic:
            best, best_aic = lag, aic
    return best


def level_t(r: np.ndarray, lag: int, n: int, constant: bool) -> float:
    """t-statistic of the level in the fit with ``lag`` lagged changes over ``n`` rows; NaN when
    the series does not determine it."""
    base = 2 if constant else 1
    k = base + lag
    a, rhs = r[:k, :k], r[:, -1]
    if n <= k or not np.all(np.diag(a)):
        return math.nan
    coef = np.linalg.solve(a, rhs[:k])
    ssr = float(rhs[k:] @ rhs[k:])
    inverse = np.linalg.inv(a)
    level = base - 1
    variance = ssr / (n - k) * float(inverse[level] @ inverse[level])
    if variance <= 0:
        return math.nan
    return float(coef[level] / math.sqrt(variance))
