"""Half-life and cointegration test of many short series at once, in numpy.

A panel is a (series, time) matrix whose rows are series from their first value on, with zeros
behind their last. The results are those of ``stats.half_life`` and of ``stats.adf`` without a
constant: products of a series with its own shifts stand for the rows of the regressions. A fit
whose columns are too near to each other for products goes through the triangular factors of
``unit_root`` instead.
"""

from __future__ import annotations

import math

import numpy as np

from tidepair.functions import unit_root

#: Series whose products are made at once, so that they stay in a core's cache.
AT_ONCE = 512
#: Share of a column that is left beside the others, below which products lose too many digits.
LEAST_SHARE = 1e-6


def half_lives(panel: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reversion, half-life in bars); NaN where a series has too few or equal values."""
    rows = np.arange(len(panel))
    last = np.maximum(n - 1, 0)
    first, end = panel[:, 0], panel[rows, last]
    second = panel[:, min(1, panel.shape[1] - 1)]
    # The first change counts twice.
    again = second - first
    squares = np.einsum("bt,bt->b", panel, panel)
    sl = panel.sum(axis=1) - end + first
    sr = end - first + again
    sll = squares - end * end + first * first
    slr = np.einsum("bt,bt->b", panel[:, :-1], panel[:, 1:]) - (squares - end * end) + first * again
    down = n * sll - sl * sl
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where((n >= 2) & (down > 0), (n * slr - sl * sr) / down, np.nan)
        return slope, np.where(slope >= 0, np.inf, -math.log(2.0) / slope)


def p_values(stat: np.ndarray, n_vars: int = 1) -> np.ndarray:
    """``unit_root.p_value`` of many statistics."""
    switch, low, high, below, above = unit_root.RESPONSE_SURFACE[n_vars]
    part = lambda powers: sum(c * stat**k for k, c in enumerate(powers))
    z = np.where(stat <= switch, part(below), part(above)) / -math.sqrt(2.0)
    p = np.array([0.5 * math.erfc(v) for v in z.tolist()])
    return np.where(stat > high, 1.0, np.where(stat < low, 0.0, p))


def _factor(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular factors of (row, column, series) matrices, and which of them are exact enough."""
    out, good = np.zeros_like(gram), np.ones(gram.shape[2], dtype=bool)
    for k in range(len(gram)):
        column = gram[k:, k] - np.einsum("ijb,jb->ib", out[k:, :k], out[k, :k])
        good &= column[0] > LEAST_SHARE * gram[k, k]
        out[k:, k] = column / np.sqrt(column[0])
    return out, good


def _products(level: np.ndarray, change: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """Products of [level, changes 1 .. ``top`` before, change], (row, column, series), the lower half alone.

    Of two earlier changes the sum is that of the two changes after them, but for one place at
    either end.
    """
    width = change.shape[1]
    at = np.maximum(n - 2, 0)[:, None] - np.arange(top + 1)
    tail = np.take_along_axis(change, np.maximum(at, 0), axis=1).T
    head = change[:, top::-1].T
    # Change k before is column k, the change itself the last one.
    column = [top + 1, *range(1, top + 1)]
    out = np.zeros((top + 2, top + 2, len(n)))
    out[0, 0] = np.einsum("bt,bt->b", level[:, top:], level[:, top:])
    sums = []
    for k in range(top + 1):
        before = change[:, top - k : width - k]
        out[column[k], 0] = np.einsum("bt,bt->b", level[:, top:], before)
        sums.append(np.einsum("bt,bt->b", change[:, top:], before))
        out[top + 1, column[k]] = sums[k]
    for i in range(1, top + 1):
        sums = [sums[k] + head[i] * head[i + k] - tail[i - 1] * tail[i - 1 + k] for k in range(top + 1 - i)]
        for k, total in enumerate(sums):
            out[i + k, i] = total
    return out


def _single(values: np.ndarray, top: int) -> tuple[float, int]:
    """The same test of one series by triangular factors."""
    fit = lambda lag: unit_root.triangle(unit_root.design(values, lag, lag + 1, False))
    used = unit_root.choose_lag(fit(top), len(values) - 1 - top, False)
    return unit_root.level_t(fit(used), used, len(values) - 1 - used, False), used


def level_tests(panel: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, lags by AIC) of the level in regressions without a constant; NaN and -1 where rows are too few."""
    stat, lag = np.full(len(n), np.nan), np.full(len(n), -1)
    sizes, which = np.unique(n, return_inverse=True)
    tops = np.array([unit_root.max_lag(int(size), False) for size in sizes], dtype=np.int64)
    tops = np.where((tops < 0) | (sizes <= tops + 3), -1, tops)[which] if len(sizes) else n
    for top in np.unique(tops[tops >= 0]).tolist():
        at = np.flatnonzero(tops == top)
        for lo in range(0, len(at), 16 * AT_ONCE):
            some = at[lo : lo + 16 * AT_ONCE]
            with np.errstate(divide="ignore", invalid="ignore"):
                stat[some], lag[some] = _tests(panel[some, : int(n[some].max())], n[some], top)
    return stat, lag


def _tests(panel: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    inside = np.arange(panel.shape[1] - 1) < (n - 1)[:, None]
    level, change = np.where(inside, panel[:, :-1], 0.0), np.where(inside, np.diff(panel, axis=1), 0.0)
    grams = np.zeros((top + 2, top + 2, len(n)))
    used, good = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=bool)
    for lo in range(0, len(n), AT_ONCE):
        at = slice(lo, lo + AT_ONCE)
        gram = _products(level[at], change[at], n[at], top)
        factor, good[at] = _factor(gram)
        grams[:, :, at] = gram
        # What is left of the change beside the first columns, for each number of them.
        left = np.cumsum((factor[-1] ** 2)[::-1], axis=0)[::-1][1:]
        rows = n[at] - 1 - top
        aic = rows * (np.log(2 * math.pi * left / rows) + 1) + 2 * np.arange(1, top + 2)[:, None]
        used[at] = np.argmin(np.where(good[at], aic, 0.0), axis=0)
    stat = np.zeros(len(n))
    for lag in np.unique(used[good]).tolist():
        at = np.flatnonzero(good & (used == lag))
        # The level comes behind the lags, so that its coefficient is read off the factor.
        order = [*range(1, lag + 1), 0, top + 1]
        gram = np.tril(grams.transpose(2, 0, 1)[at], -1)
        gram = (gram + gram.transpose(0, 2, 1))[:, order][:, :, order]
        gram[:, range(lag + 2), range(lag + 2)] = grams[order, order][:, at].T
        # A shorter lag has more rows at the start.
        more = np.arange(lag, top)
        first = np.stack([*(change[at][:, more - k] for k in range(1, lag + 1)), level[at][:, more], change[at][:, more]], axis=2)
        factor, good[at] = _factor(np.ascontiguousarray((gram + first.transpose(0, 2, 1) @ first).transpose(1, 2, 0)))
        free = n[at] - 1 - lag - (1 + lag)
        stat[at] = factor[-1, -2] / (factor[-1, -1] / np.sqrt(free))
        good[at] &= free > 0
    for i in np.flatnonzero(~good).tolist():
        stat[i], used[i] = _single(panel[i, : n[i]], top)
    return stat, used
