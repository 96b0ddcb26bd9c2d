"""Stateful processors: the batch step functions with their state kept per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepair.operators.kalman import initial_state, step
from tidepair.operators.signals import DEMO_ENTRY, ENTRY_LONG, ENTRY_LONG_SPREAD, ENTRY_SHORT, ENTRY_SHORT_SPREAD, EXIT_ALL

SNAPSHOT = "leg_1 string, leg_2 string, ts timestamp, y double, x double"
SIGNAL = (
    "leg_1 string, leg_2 string, ts timestamp, signal_type string, side int, y double, x double, "
    "z_score double, beta double, predicted_y double, error double"
)
REVERSION = "leg_1 string, leg_2 string, ts timestamp, signal_type string, y double, x double, z_score double, spread double"
POSITIONED = "leg_1 string, leg_2 string, ts timestamp, signal_type string, side int, y double, x double, z_score double, spread double"
RATIO = "leg_1 string, leg_2 string, ts timestamp, signal_type string, y double, x double, ratio double"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in event-time order."""
    return pd.concat(list(rows), ignore_index=True).sort_values("ts", ignore_index=True)


class KeyedStep(StatefulProcessor):
    """Base: one flat state row per key, stepped through the batch's rows in time order.

    A step that names ``idle_s`` (or overrides ``expiry_ms``) forgets a key whose state is due: an
    event-time timer stands at that moment and moves with every batch of rows.
    """

    state_schema: str
    columns: Sequence[str]
    #: Seconds of event time without rows after which a key is forgotten; None keeps it for good.
    idle_s: float | None = None

    #: Rows before a stretch that settle the state it is entered with, apart from the mode; None: no number does.
    memory: int | None = None
    #: The few values that the rest of the state (a position, say) can have.
    modes: Sequence = (None,)

    def with_mode(self, state: tuple, mode) -> tuple:
        """``state`` as if the step were in ``mode``."""
        return state

    def mode_of(self, state: tuple):
        return None

    def forgets(self) -> bool:
        return self.idle_s is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.due = handle.getValueState("due", "ms bigint") if self.forgets() else None

    def start(self) -> tuple:
        raise NotImplementedError

    def advance(self, state: tuple, row) -> tuple[tuple, tuple | None]:
        """One row: the new state and the output (without the key), or None."""
        raise NotImplementedError

    def expiry_ms(self, state: tuple, last_ms: int) -> int:
        """Event time at which nothing depends on the state any more."""
        return last_ms + int(self.idle_s * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.start()
        out, last = [], None
        for row in _ordered(rows).itertuples(index=False):
            state, emitted = self.advance(state, row)
            last = row.ts
            if emitted is not None:
                out.append((*key, *emitted))
        self.state.update(state)
        if self.due is not None and last is not None:
            self._stand(self.expiry_ms(state, pd.Timestamp(last).value // 1_000_000))
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def _stand(self, at_ms: int) -> None:
        """Move the key's timer."""
        if self.due.exists():
            before = self.due.get()[0]
            if before == at_ms:
                return
            self.handle.deleteTimer(before)
        self.due.update((at_ms,))
        self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


class PriceBoard(KeyedStep):
    """Latest price of both legs; a snapshot on every update once both are known."""

    state_schema = "y double, x double"
    columns = ["leg_1", "leg_2", "ts", "y", "x"]

    def start(self):
        return None, None

    def advance(self, state, row):
        y = state[0] if pd.isna(row.y) else float(row.y)
        x = state[1] if pd.isna(row.x) else float(row.x)
        return (y, x), None if y is None or x is None else (row.ts, y, x)


class KalmanPairStrategy(KeyedStep):
    """Price board, filter step and position rule (absolute exit, no re-entry in the exit bar)."""

    state_schema = (
        "y double, x double, m0 double, m1 double, p00 double, p01 double, p10 double, p11 double, position int"
    )
    columns = [
        "leg_1", "leg_2", "ts", "signal_type", "side", "y", "x", "z_score", "beta", "predicted_y", "error",
    ]

    def __init__(self, entry: float = 2.0, exit_: float = 0.5, delta: float = 1e-4, r: float = 1e-3):
        self.entry, self.exit, self.delta, self.r = entry, exit_, delta, r

    def start(self):
        return (None, None, *initial_state(), 0)

    def advance(self, state, row):
        y = state[0] if pd.isna(row.y) else float(row.y)
        x = state[1] if pd.isna(row.x) else float(row.x)
        if y is None or x is None:
            return (y, x, *state[2:]), None
        filtered, error, s = step(state[2:8], y, x, self.delta, self.r)
        position, signal, side = state[8], None, 0
        if s > 0:
            z = error / s**0.5
            if position == 0 and abs(z) > self.entry:
                position = side = -1 if z > 0 else 1
                signal = ENTRY_LONG_SPREAD if side > 0 else ENTRY_SHORT_SPREAD
            elif position != 0 and abs(z) < self.exit:
                side, position, signal = position, 0, EXIT_ALL
        emitted = None
        if signal is not None:
            emitted = (row.ts, signal, side, y, x, z, filtered[1], y - error, error)
        return (y, x, *filtered, position), emitted


class MeanReversionStrategy(KeyedStep):
    """Price board and an entry on every bar whose spread is far from its trailing mean."""

    state_schema = "y double, x double, seen array<double>"
    columns = ["leg_1", "leg_2", "ts", "signal_type", "y", "x", "z_score", "spread"]

    def __init__(self, hedge_ratio: float, window: int = 30, threshold: float = 2.0, min_obs: int = 20):
        self.hedge_ratio, self.window, self.threshold, self.min_obs = hedge_ratio, window, threshold, min_obs
        # Rows of both legs: the window is full, whatever came before.
        self.memory = window

    def start(self):
        return None, None, []

    def score(self, seen: list, spread: float) -> float | None:
        mean = sum(seen) / len(seen)
        std = (sum((v - mean) ** 2 for v in seen) / len(seen)) ** 0.5
        return (spread - mean) / std if len(seen) >= self.min_obs and std > 0 else None

    def watch(self, state, row):
        """Prices, trailing spreads and z after a row; z is None while there is none."""
        y = state[0] if pd.isna(row.y) else float(row.y)
        x = state[1] if pd.isna(row.x) else float(row.x)
        if y is None or x is None:
            return (y, x, state[2]), None, None
        spread = y - self.hedge_ratio * x
        seen = [*state[2], spread][-self.window :]
        return (y, x, seen), self.score(seen, spread), spread

    def advance(self, state, row):
        state, z, spread = self.watch(state, row)
        if z is None or abs(z) <= self.threshold:
            return state, None
        return state, (row.ts, ENTRY_LONG if z < 0 else ENTRY_SHORT, state[0], state[1], z, spread)


class PositionedReversion(MeanReversionStrategy):
    """Mean reversion that holds a position: entered when flat, left when the spread is back near its mean."""

    state_schema = "y double, x double, seen array<double>, position int"
    columns = ["leg_1", "leg_2", "ts", "signal_type", "side", "y", "x", "z_score", "spread"]
    modes = (0, 1, -1)

    def __init__(self, hedge_ratio: float, window: int = 30, entry: float = 2.0, exit_: float = 0.5, min_obs: int = 20):
        super().__init__(hedge_ratio, window, entry, min_obs)
        self.exit = exit_

    def start(self):
        return None, None, [], 0

    def with_mode(self, state, mode):
        return (*state[:3], mode)

    def mode_of(self, state):
        return state[3]

    def advance(self, state, row):
        position = state[3]
        seen, z, spread = self.watch(state, row)
        signal, side = None, 0
        if z is not None:
            if position == 0 and abs(z) > self.threshold:
                position = side = 1 if z < 0 else -1
                signal = ENTRY_LONG if side > 0 else ENTRY_SHORT
            elif position != 0 and abs(z) < self.exit:
                side, position, signal = position, 0, EXIT_ALL
        return (*seen, position), None if signal is None else (row.ts, signal, side, seen[0], seen[1], z, spread)


class RatioStrategy(KeyedStep):
    """Price board and an entry on every bar whose price ratio is above the threshold."""

    state_schema = "y double, x double"
    columns = ["leg_1", "leg_2", "ts", "signal_type", "y", "x", "ratio"]

    def __init__(self, threshold: float = 1000.0):
        self.threshold = threshold

    def start(self):
        return None, None

    def advance(self, state, row):
        y = state[0] if pd.isna(row.y) else float(row.y)
        x = state[1] if pd.isna(row.x) else float(row.x)
        emitted = None
        if y is not None and x is not None and x != 0 and y / x > self.threshold:
            emitted = (row.ts, DEMO_ENTRY, y, x, y / x)
        return (y, x), emitted


class OrderGate(KeyedStep):
    """Passes a signal when the key is not cooling down, nor over its rate, nor in a closed hour."""

    state_schema = "last_us bigint, minute bigint, sent int"

    def __init__(
        self,
        columns: Sequence[str],
        cooldown_s: float = 60.0,
        max_per_minute: int | None = None,
        forbidden_hours: Sequence[int] = (),
    ):
        self.columns = list(columns)
        self.cooldown_us = int(cooldown_s * 1_000_000)
        self.max_per_minute, self.forbidden = max_per_minute, set(forbidden_hours)

    def start(self):
        return None, -1, 0

    def forgets(self):
        return True

    def expiry_ms(self, state, last_ms):
        """The end of the cooldown, and of the minute whose signals are counted."""
        sent_us, minute, _ = state
        cooled = last_ms if sent_us is None else -(-(sent_us + self.cooldown_us) // 1000)
        return max(cooled, (minute + 1) * 60_000 if self.max_per_minute is not None else cooled)

    def advance(self, state, row):
        last, minute, sent = state
        now = int(pd.Timestamp(row.ts).value // 1000)
        if row.ts.hour in self.forbidden:
            return state, None
        if last is not None and now - last < self.cooldown_us:
            return state, None
        this_minute = now // 60_000_000
        sent = sent if this_minute == minute else 0
        if self.max_per_minute is not None and sent >= self.max_per_minute:
            return (last, this_minute, sent), None
        values = row._asdict()
        return (now, this_minute, sent + 1), tuple(values[c] for c in self.columns[2:])
