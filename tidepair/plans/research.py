"""Parameter grids and the portfolio backtest: work that depends on fewer parameters runs first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.operators import align, pnl
from tidepair.operators.kalman import kalman, kalman_library
from tidepair.operators.ordered import MONTH, with_position
from tidepair.operators.pairs import PAIR, pair_bars
from tidepair.operators.positions import positions, trades
from tidepair.operators.signals import pair_orders, standing_ledger
from tidepair.operators.windows import rolling_z
from tidepair.plans.discovery import cointegrated_pairs
from tidepair.plans.strategies import run_strategy
from tidepair.session import stage
from tidepair.streaming.processors import KeyedStep

KEYS = [*PAIR, "delta"]


def filter_diagnostics(filtered: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean squared innovation and spread of z: too small an error means the filter overfits."""
    return filtered.groupBy(*keys).agg(
        F.avg(F.col("error") * F.col("error")).alias("mse"), F.stddev_samp("z_score").alias("z_std")
    )


def _grid(rows: DataFrame, deltas, entries, exits) -> DataFrame:
    known = rows.select(*PAIR).distinct()
    return pnl.with_grid(known, delta=deltas, entry=entries, exit=exits)


def raw_grid(
    rows: DataFrame,
    deltas: Sequence[float],
    entries: Sequence[float],
    exits: Sequence[float],
    shares: float,
    cost: float,
    seconds: int = MONTH,
) -> DataFrame:
    """Grid on the filter's own z with absolute exits. The filter runs once per delta, and each
    (pair, delta) chunk is walked for all thresholds in one task."""
    scored = stage(kalman(rows, deltas=deltas, seconds=seconds), "scored")
    combos = [(e, x) for e in entries for x in exits]
    events = positions(scored, KEYS, combos, "abs", False, seconds=seconds)
    return pnl.grid_summary(events, _grid(rows, deltas, entries, exits), [*KEYS, "entry", "exit"], shares, cost)


def rolling_grid(
    rows: DataFrame,
    deltas: Sequence[float],
    entries: Sequence[float],
    exits: Sequence[float],
    shares: float,
    cost: float,
    window: int = 30,
    seconds: int = MONTH,
) -> DataFrame:
    """Grid on the rolling z of the filter's spread with signed exits."""
    filtered = stage(kalman(rows, deltas=deltas, seconds=seconds), "filtered")
    scored = stage(rolling_z(filtered.select(*KEYS, "ts", "pos", "spread"), KEYS, n=window), "scored")
    combos = [(e, x) for e in entries for x in exits]
    events = positions(scored, KEYS, combos, "signed", False, window, z="rolling_z", seconds=seconds)
    return pnl.grid_summary(events, _grid(rows, deltas, entries, exits), [*KEYS, "entry", "exit"], shares, cost)


def pair_pnl(
    rows: DataFrame,
    delta: float = 1e-5,
    entry: float = 2.5,
    exit_: float = 0.0,
    window: int = 30,
    shares: float = 100,
    cost: float | None = None,
    seconds: int = MONTH,
) -> DataFrame:
    """Realised net PnL on every bar of every pair, zero where nothing closes."""
    if cost is None:
        cost = pnl.round_trip_cost(shares, shares)
    filtered = stage(kalman_library(rows, deltas=[delta], seconds=seconds).select(*KEYS, "ts", "pos", "spread"), "filtered")
    scored = stage(rolling_z(filtered, KEYS, n=window), "scored")
    events = positions(scored, KEYS, [(entry, exit_)], "signed", False, window, z="rolling_z", seconds=seconds)
    closed = trades(events.where("is_exit"), shares, cost).select(*PAIR, "ts", "pnl")
    return (
        scored.select(*PAIR, "ts")
        .join(closed, [*PAIR, "ts"], "left")
        .withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    )


def portfolio_backtest(
    closes: DataFrame,
    width: str = "15 minutes",
    min_corr: float = 0.8,
    max_p: float = 0.05,
    shares: float = 100,
    cost: float | None = None,
    seconds: int = MONTH,
    **rule,
) -> DataFrame:
    """From prices to the portfolio scorecard: common timestamps, pair gates, one backtest per
    surviving pair on resampled bars, one curve."""
    shared = stage(align.align_inner_all(closes).select("symbol", "ts", "close"), "shared")
    chosen = stage(cointegrated_pairs(shared, min_corr, max_p, seconds), "chosen")
    bars = align.resample_last(shared, width)
    rows = stage(with_position(pair_bars(bars, chosen), PAIR, ["ts"], "pos", seconds), "rows")
    result = stage(pair_pnl(rows, shares=shares, cost=cost, seconds=seconds, **rule), "pnl")
    return pnl.scorecard(result, seconds=seconds)


def board_backtest(
    closes: DataFrame, chosen: DataFrame, step: KeyedStep, schema: str, qty: float, hedge_qty: float, seconds: int = MONTH
) -> DataFrame:
    """A strategy over the filled board, and the ledger of its orders.

    Every timestamp of any instrument is a tick of the board once all have a price; the step goes
    through the board's rows of each pair, and orders are filled at the price that stands.
    """
    board = stage(align.align_outer_ffill(closes, seconds=seconds), "board")
    found = run_strategy(pair_bars(board, chosen.select(*PAIR)), step, schema, seconds=seconds)
    orders = pair_orders(found, qty, hedge_qty)
    return standing_ledger(orders, closes, seconds).select(
        F.col("ts").alias("time"), "signal", F.col("key").alias("asset"), "action", "qty", "price"
    )
