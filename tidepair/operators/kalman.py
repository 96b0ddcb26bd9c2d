"""Adaptive hedge ratio: random-walk regression of one leg on the other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidepair.operators.ordered import MONTH
from tidepair.operators.pairs import PAIR
from tidepair.operators.scan import ChunkScan, run_scan

STATE_SIZE = 6  # intercept, slope and their covariance p00, p01, p10, p11


def initial_state(p0: float = 1.0) -> list[float]:
    """Zero mean and a covariance with every entry ``p0``."""
    return [0.0, 0.0, p0, p0, p0, p0]


def step(state: Sequence[float], y: float, x: float, q: float, r: float):
    """One observation. Returns the new state, the innovation and its variance."""
    return update(state, y, x, q, r)[:3]


def update(state: Sequence[float], y: float, x: float, q: float, r: float):
    """``step`` with the gain of intercept and slope as a last part; takes numbers or arrays."""
    m0, m1, p00, p01, p10, p11 = state
    p00, p11 = p00 + q, p11 + q
    a0, a1 = p00 + p01 * x, p10 + p11 * x
    h0, h1 = p00 + x * p10, p01 + x * p11
    s = h0 + h1 * x + r
    e = y - (m0 + m1 * x)
    k0, k1 = a0 / s, a1 / s
    new = (m0 + k0 * e, m1 + k1 * e, p00 - k0 * h0, p01 - k0 * h1, p10 - k1 * h0, p11 - k1 * h1)
    return new, e, s, (k0, k1)


#: States are worked out with more digits than they are handed on with: next to large prices the
#: covariance is nearly singular, and first steps and merged spans would cost a state half its digits.
WIDE = np.longdouble

# 2 x 2 matrices are tuples (top left, top right, bottom left, bottom right) of arrays, so that one
# operation serves all noises and spans at once.


def _times(a, b):
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]


def _plus(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _turned(a):
    return a[0], a[2], a[1], a[3]


def _on(a, v):
    return a[0] * v[0] + a[1] * v[1], a[2] * v[0] + a[3] * v[1]


def _inverse_next_to_one(a):
    """Inverse of the identity plus ``a``."""
    p, q, r, s = 1.0 + a[0], a[1], a[2], 1.0 + a[3]
    d = p * s - q * r
    return s / d, -q / d, -r / d, p / d


def _merge(e1, e2):
    """Element of two consecutive spans of observations."""
    a1, b1, c1, n1, j1 = e1
    a2, b2, c2, n2, j2 = e2
    inside = _inverse_next_to_one(_times(c1, j2))
    through = _times(a2, inside)
    back = _times(_turned(a1), _turned(inside))
    lifted, lowered = _on(c1, n2), _on(j2, b1)
    return (
        _times(through, a1),
        _plus(_on(through, (b1[0] + lifted[0], b1[1] + lifted[1])), b2),
        _plus(_times(_times(through, c1), _turned(a2)), c2),
        _plus(_on(back, (n2[0] - lowered[0], n2[1] - lowered[1])), n1),
        _plus(_times(_times(back, j2), a1), j1),
    )


def _flat(element) -> list[np.ndarray]:
    return [c for part in element for c in part]


def _parts(numbers) -> tuple:
    return tuple(numbers[0:4]), tuple(numbers[4:6]), tuple(numbers[6:10]), tuple(numbers[10:12]), tuple(numbers[12:16])


def enter_spans(state: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """States after spans, from the states before them (6 numbers) and the spans' elements (16)."""
    a, b, c, eta, j = _parts(elements)
    mean, cov = tuple(state[:2]), tuple(state[2:])
    through = _times(a, _inverse_next_to_one(_times(cov, j)))
    lifted = _on(cov, eta)
    mean = _plus(_on(through, (mean[0] + lifted[0], mean[1] + lifted[1])), b)
    p00, p01, p10, p11 = _plus(_times(_times(through, cov), _turned(a)), c)
    return np.stack([*mean, p00, (p01 + p10) / 2, (p01 + p10) / 2, p11])


class _Lanes:
    """Chunks cut into lanes, stretches that are walked row by row next to all other lanes.

    A lane has about as many rows as the longest chunk has lanes: both are walked in turn.
    """

    def __init__(self, begins: np.ndarray):
        lengths = np.diff(begins)
        size = 1 << (int(lengths.max(initial=1)).bit_length() + 1) // 2
        self.size = size
        self.count = -(-lengths // size)
        self.chunk = np.repeat(np.arange(len(lengths)), self.count)
        self.number = np.arange(len(self.chunk)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.begin = begins[:-1][self.chunk] + self.number * size
        self.length = np.minimum(begins[1:][self.chunk] - self.begin, size)

    def rows(self, lanes: np.ndarray):
        """Row k of all ``lanes`` that have one, for k in turn; longest lanes come first."""
        length = self.length[lanes]
        for k in range(int(length.max(initial=0))):
            yield k, self.begin[lanes[: int((length > k).sum())]] + k

    def longest_first(self, lanes: np.ndarray) -> np.ndarray:
        return lanes[np.argsort(-self.length[lanes], kind="stable")]


class KalmanScan(ChunkScan):
    """The filter under several process noises at once; one output row per row and noise."""

    schema = (
        "delta double, ts timestamp, pos bigint, y double, x double, beta double, intercept double, "
        "error double, s double, std_dev double, z_score double, spread double"
    )

    def __init__(self, deltas: Sequence[float], r: float, p0: float, predict_first: bool):
        self.deltas = [float(d) for d in deltas]
        self.r, self.p0, self.predict_first = float(r), float(p0), predict_first

    def start(self):
        return np.tile(initial_state(self.p0), len(self.deltas))

    def _noise(self, k: int, fresh: np.ndarray):
        """Process noise (noise, lane) of the k-th rows; ``fresh`` lanes may begin without any."""
        delta = np.array(self.deltas)[:, None]
        return np.where(fresh, 0.0, delta) if k == 0 and not self.predict_first else delta

    def _lane_elements(self, y, x, lanes: _Lanes, first, wanted: np.ndarray) -> np.ndarray:
        """(16, noise, wanted): what lanes do to any entering state, walked from a state known for sure.

        From there the filter's own mean and covariance are the element's b and C; what a change of
        the entering state does to them (A) and what the observations say about it (eta, J) is
        gathered on the way.
        """
        order = np.argsort(-lanes.length[wanted], kind="stable")
        own = wanted[order]
        fresh = (first[lanes.chunk] & (lanes.number == 0))[own]
        y, x = y.astype(WIDE), x.astype(WIDE)
        zero = np.zeros((len(self.deltas), len(own)), dtype=WIDE)
        total = [zero + 1, zero, zero, zero + 1, *[zero] * 12]
        total = [c.copy() for c in total]
        # A lane that begins a series is entered with the start state alone: its element is what comes out.
        for t, v in zip(total, [0, 0, 0, 0, *initial_state(self.p0)]):
            t[:, fresh] = v
        for k, at in lanes.rows(own):
            live = len(at)
            a, b, c, eta, j = _parts([t[:, :live] for t in total])
            yk, xk = y[at], x[at]
            now, e, s, (k0, k1) = update((*b, *c), yk, xk, self._noise(k, fresh[:live]), self.r)
            g0, g1 = a[0] + xk * a[2], a[1] + xk * a[3]
            w0, w1 = g0 / s, g1 / s
            new = [
                a[0] - k0 * g0, a[1] - k0 * g1, a[2] - k1 * g0, a[3] - k1 * g1, *now,
                eta[0] + w0 * e, eta[1] + w1 * e, j[0] + w0 * g0, j[1] + w0 * g1, j[2] + w1 * g0, j[3] + w1 * g1,
            ]
            for t, v in zip(total, new, strict=True):
                t[:, :live] = v
        out = np.empty((16, len(self.deltas), len(own)), dtype=WIDE)
        out[:, :, order] = np.stack(total)
        return out

    def summarise(self, rows, first):
        return self.summarise_all(rows, np.array([0, len(rows)]), np.array([first]))[0]

    def summarise_all(self, rows, begins, first):
        y, x = rows["y"].to_numpy(dtype=float), rows["x"].to_numpy(dtype=float)
        lanes = _Lanes(begins)
        elements = self._lane_elements(y, x, lanes, first, np.arange(len(lanes.chunk)))
        # Lanes of a chunk merge in order; chunks with most lanes stand first, so that live ones are a prefix.
        order = np.argsort(-lanes.count, kind="stable")
        where = np.cumsum(lanes.count) - lanes.count
        total = _parts(list(elements[:, :, where[order]]))
        for k in range(1, int(lanes.count.max(initial=1))):
            live = int((lanes.count[order] > k).sum())
            nxt = _parts(list(elements[:, :, where[order][:live] + k]))
            merged = _flat(_merge(_parts([c[:, :live] for c in _flat(total)]), nxt))
            total = _parts([np.concatenate([m, c[:, live:]], axis=1) for m, c in zip(merged, _flat(total), strict=True)])
        numbers = np.empty((16, len(self.deltas), len(order)), dtype=WIDE)
        numbers[:, :, order] = np.stack(_flat(total))
        # By noise, then the element's numbers; as doubles, and behind them what these leave.
        numbers = numbers.transpose(2, 1, 0).reshape(len(order), -1)
        rounded = numbers.astype(float)
        return list(np.concatenate([rounded, (numbers - rounded).astype(float)], axis=1))

    def advance(self, state, summary):
        n = len(self.deltas)
        rounded, rest = summary.reshape(2, n, -1)
        return enter_spans(state.reshape(n, -1).T, (rounded.astype(WIDE) + rest).T).T.ravel().astype(float)

    def _lane_states(self, y, x, lanes: _Lanes, states, first) -> np.ndarray:
        """(number, noise, lane): the states that enter the lanes of all chunks."""
        n = len(self.deltas)
        out = np.empty((STATE_SIZE, n, len(lanes.chunk)), dtype=WIDE)
        heads = np.flatnonzero(lanes.number == 0)
        out[:, :, heads] = np.stack(states).reshape(-1, n, STATE_SIZE).transpose(2, 1, 0)
        if len(heads) < len(lanes.chunk):
            followed = np.flatnonzero(np.append(lanes.number[1:] > 0, False))
            elements = np.empty((16, n, len(lanes.chunk)), dtype=WIDE)
            elements[:, :, followed] = self._lane_elements(y, x, lanes, first, followed)
            order = np.argsort(-lanes.count, kind="stable")
            for k in range(1, int(lanes.count.max())):
                lane = heads[order[: int((lanes.count > k).sum())]] + k
                out[:, :, lane] = enter_spans(out[:, :, lane - 1], elements[:, :, lane - 1])
        return out

    def replay(self, rows, state, first):
        return self.replay_all(rows, np.array([0, len(rows)]), [state], np.array([first]))[0]

    def replay_all(self, rows, begins, states, first):
        y, x = rows["y"].to_numpy(dtype=float), rows["x"].to_numpy(dtype=float)
        lanes, y_wide, x_wide = _Lanes(begins), y.astype(WIDE), x.astype(WIDE)
        now = self._lane_states(y, x, lanes, states, first)
        own = lanes.longest_first(np.arange(len(lanes.chunk)))
        fresh = (first[lanes.chunk] & (lanes.number == 0))[own]
        now = tuple(now[:, :, own])
        trace = np.empty((4, len(self.deltas), len(y)))
        for k, at in lanes.rows(own):
            live = len(at)
            now, error, s = step(tuple(c[:, :live] for c in now), y_wide[at], x_wide[at], self._noise(k, fresh[:live]), self.r)
            for out, c in zip(trace, (now[1], now[0], error, s), strict=True):
                out[:, at] = c
        beta, intercept, error, s = trace.reshape(4, -1)
        many = len(self.deltas)
        with np.errstate(invalid="ignore"):
            std = np.sqrt(np.where(s > 0, s, np.nan))
        with np.errstate(divide="ignore", invalid="ignore"):
            # y - beta * x without the cancellation: what the update leaves of an error is error * r / s.
            spread = intercept + error * (self.r / s)
        y, x = np.tile(y, many), np.tile(x, many)
        out = pd.DataFrame(
            {
                "delta": np.repeat(self.deltas, len(rows)),
                "ts": np.tile(rows["ts"].to_numpy(), many),
                "pos": np.tile(rows["pos"].to_numpy(), many),
                "y": y,
                "x": x,
                "beta": beta,
                "intercept": intercept,
                "error": error,
                "s": s,
                "std_dev": std,
                "z_score": error / std,
                "spread": spread,
            },
            copy=False,
        )
        return out, np.tile(np.repeat(np.arange(len(begins) - 1), np.diff(begins)), many)


def kalman(
    pairs: DataFrame,
    keys: Sequence[str] = PAIR,
    deltas: Sequence[float] = (1e-4,),
    r: float = 1e-3,
    p0: float = 1.0,
    predict_first: bool = True,
    seconds: int = MONTH,
) -> DataFrame:
    """Filter numbered, aligned pair rows ``(keys, ts, pos, y, x)``.

    ``beta`` and ``intercept`` are posterior, ``error`` and ``s`` (its variance) come from the
    prior, ``spread`` uses the posterior slope and keeps its digits where it is a tiny part of the prices. ``predict_first`` False leaves the process noise
    out of the first step, as filters do that take the initial state for the first observation.
    """
    rows = pairs.select(*keys, "ts", "pos", "y", "x")
    return run_scan(rows, KalmanScan(deltas, r, p0, predict_first), keys, "ts", seconds)


def kalman_library(pairs: DataFrame, keys: Sequence[str] = PAIR, deltas: Sequence[float] = (1e-5,), **kw) -> DataFrame:
    """Flavour with unit observation noise and no process noise in the first step."""
    return kalman(pairs, keys, deltas, r=1.0, predict_first=False, **kw)
