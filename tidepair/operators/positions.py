"""Position rules on z-scores: entries, exits and the PnL of round trips."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.operators.ordered import MONTH, with_running_sum
from tidepair.operators.scan import ChunkScan, run_scan

INHERITED = float("nan")  # spread at entry of a position opened before the chunk


class Triggers:
    """Rows at which a rule can open or close, found once per distinct threshold.

    Rule ``signed`` leaves a long when z rises above ``-exit`` and a short when z falls below
    ``exit``; rule ``abs`` leaves either when ``|z| < exit``. Null z-scores compare false and so
    are passed over.
    """

    def __init__(self, z: np.ndarray, spread: np.ndarray, thresholds, rule: str):
        self.z, self.spread = z, spread
        size = np.abs(z)
        self.opens = {e: np.flatnonzero(size > e) for e in {t[0] for t in thresholds}}
        exits = {t[1] for t in thresholds}
        if rule == "signed":
            self.closes = {x: {1: np.flatnonzero(z > -x), -1: np.flatnonzero(z < x)} for x in exits}
        else:
            near = {x: np.flatnonzero(size < x) for x in exits}
            self.closes = {x: {1: near[x], -1: near[x]} for x in exits}

    def walk(self, entry: float, exit_: float, same_bar_reentry: bool, position: int, entry_spread: float):
        """Follow one position through the rows, jumping from trigger to trigger. Returns the
        events ``(row, side, is_exit, points)`` and the closing position and entry spread."""
        opens, closes = self.opens[entry], self.closes[exit_]
        events, at = [], 0
        while True:
            ahead = opens if position == 0 else closes[position]
            k = ahead.searchsorted(at)
            if k == len(ahead):
                return events, position, entry_spread
            at = int(ahead[k])
            if position == 0:
                position = 1 if self.z[at] < 0 else -1
                entry_spread = float(self.spread[at])
                events.append((at, position, False, 0.0))
                at += 1
            else:
                events.append((at, position, True, position * (float(self.spread[at]) - entry_spread)))
                position = 0
                if not same_bar_reentry:
                    at += 1


class PositionScan(ChunkScan):
    """All (entry, exit) rules over the same rows; ``emit`` chooses events or one row per bar."""

    _START = (-1, 0, 1)

    def __init__(
        self,
        thresholds: Sequence[tuple[float, float]],
        rule: str,
        same_bar_reentry: bool,
        warmup: int,
        z: str,
        spread: str,
        carry: Sequence[str],
        emit: str,
    ):
        self.thresholds = [(float(e), float(x)) for e, x in thresholds]
        if any(e < 0 for e, _ in self.thresholds):
            raise ValueError("entry thresholds must not be negative")
        if rule not in ("signed", "abs"):
            raise ValueError(f"unknown exit rule {rule!r}")
        self.rule, self.same_bar_reentry, self.warmup = rule, same_bar_reentry, warmup
        self.z, self.spread, self.carry, self.emit = z, spread, list(carry), emit
        extra = "".join(f", {c} double" for c in self.carry)
        head = "entry double, exit double, ts timestamp, pos bigint, z_score double, spread double"
        if emit == "events":
            self.schema = f"{head}, side int, is_exit boolean, points double{extra}"
        else:
            self.schema = f"{head}, position int, points double{extra}"

    def _triggers(self, rows):
        z = rows[self.z].to_numpy(dtype=float, na_value=np.nan).copy()
        z[rows["pos"].to_numpy() <= self.warmup] = np.nan
        spread = rows[self.spread].to_numpy(dtype=float, na_value=np.nan)
        return Triggers(z, spread, self.thresholds, self.rule)

    def start(self):
        return np.zeros(2 * len(self.thresholds))

    def summarise(self, rows, first):
        # Per rule and entering position: the closing position and entry spread, where a missing
        # entry spread says that the entering position is still open.
        found = self._triggers(rows)
        return np.array(
            [
                v
                for rule in self.thresholds
                for position in self._START
                for v in found.walk(*rule, self.same_bar_reentry, position, INHERITED)[1:]
            ]
        )

    def advance(self, state, summary):
        out = []
        for i in range(len(self.thresholds)):
            position, entry_spread = state[2 * i], state[2 * i + 1]
            at = 6 * i + 2 * self._START.index(int(position))
            after, opened = summary[at], summary[at + 1]
            out += [after, entry_spread if np.isnan(opened) else opened]
        return np.array(out)

    def replay(self, rows, state, first):
        found = self._triggers(rows)
        walks = [
            found.walk(*rule, self.same_bar_reentry, int(state[2 * i]), float(state[2 * i + 1]))[0]
            for i, rule in enumerate(self.thresholds)
        ]
        return self._events(rows, walks) if self.emit == "events" else self._bars(rows, walks, state)

    def _columns(self, rows, at, counts):
        """Columns of the picked rows, each rule's thresholds repeated over its rows."""
        entries, exits = np.array(self.thresholds).T
        picked = {c: rows[c].to_numpy()[at] for c in ("ts", "pos", self.z, self.spread, *self.carry)}
        head = {"entry": np.repeat(entries, counts), "exit": np.repeat(exits, counts)}
        named = {"ts": picked.pop("ts"), "pos": picked.pop("pos")}
        named |= {"z_score": picked.pop(self.z), "spread": picked.pop(self.spread)}
        return head | named, picked

    def _events(self, rows, walks):
        events = [e for walk in walks for e in walk]
        at = np.array([e[0] for e in events], dtype=np.int64)
        head, carried = self._columns(rows, at, [len(w) for w in walks])
        own = {
            "side": np.array([e[1] for e in events], dtype=np.int32),
            "is_exit": np.array([e[2] for e in events], dtype=bool),
            "points": np.array([e[3] for e in events], dtype=float),
        }
        return pd.DataFrame(head | own | carried)

    def _bars(self, rows, walks, state):
        n = len(rows)
        head, carried = self._columns(rows, np.tile(np.arange(n), len(walks)), [n] * len(walks))
        held, points = np.full((len(walks), n), np.nan), np.zeros((len(walks), n))
        for i, events in enumerate(walks):
            held[i, 0] = state[2 * i]
            for at, side, is_exit, gain in events:
                held[i, at] = 0 if is_exit else side
                points[i, at] += gain
        own = {
            "position": pd.Series(held.ravel()).ffill().to_numpy().astype(np.int32),
            "points": points.ravel(),
        }
        return pd.DataFrame(head | own | carried)


def positions(
    scored: DataFrame,
    keys: Sequence[str],
    thresholds: Sequence[tuple[float, float]],
    rule: str = "signed",
    same_bar_reentry: bool = False,
    warmup: int = 0,
    z: str = "z_score",
    spread: str = "spread",
    carry: Sequence[str] = (),
    emit: str = "events",
    seconds: int = MONTH,
) -> DataFrame:
    """Run the position rule for every (entry, exit) pair over numbered, scored rows.

    ``emit='events'`` returns one row per entry or exit, ``'bars'`` one row per bar with the
    position after it; ``points`` is the spread gained by the round trip that ends there.
    """
    scan = PositionScan(thresholds, rule, same_bar_reentry, warmup, z, spread, carry, emit)
    columns = dict.fromkeys([*keys, "ts", "pos", z, spread, *carry])
    return run_scan(scored.select(*columns), scan, keys, "ts", seconds)


def trades(events: DataFrame, shares: float = 1.0, cost: float = 0.0) -> DataFrame:
    """Events as a trade list: zero-based row, type and PnL, net of ``cost`` per round trip."""
    kind = F.concat(
        F.when(F.col("is_exit"), F.lit("EXIT")).otherwise(F.lit("ENTRY")),
        F.when(F.col("side") > 0, F.lit("_LONG")).otherwise(F.lit("_SHORT")),
    )
    pnl = F.when(F.col("is_exit"), F.col("points") * shares - cost).otherwise(F.lit(0.0))
    return (
        events.withColumn("idx", F.col("pos") - 1)
        .withColumn("type", kind)
        .withColumn("pnl", pnl)
        .drop("pos", "side", "is_exit", "points")
    )


def cumulative_pnl(bars: DataFrame, keys: Sequence[str], seconds: int = MONTH) -> DataFrame:
    """Running realised PnL of per-bar positions."""
    return with_running_sum(bars, keys, ["ts"], {"cumulative_pnl": "points"}, seconds)
