"""Pair discovery: cheap gates over all pairs first, tests only for those that pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.operators import align, pairs, stats, tiles, windows
from tidepair.operators.ordered import BLOCK_ROWS, MONTH, with_position
from tidepair.operators.pairs import PAIR
from tidepair.session import stage


#: More than rounding for publication moves a p-value or a half-life by.
P_ROUNDING, BARS_ROUNDING = 1e-4, 0.1


def universe_returns(closes: DataFrame, value: str = "close", seconds: int = MONTH) -> DataFrame:
    """Returns over the timestamps that all symbols share."""
    shared = align.align_inner_all(closes, value).select("symbol", "ts", value)
    return windows.pct_change(shared, value, "ret", seconds)


def residuals_of(rows: DataFrame, value: str = "spread") -> DataFrame:
    """Regression residuals of numbered pair rows that carry their line."""
    line = F.col("alpha") + F.col("beta") * F.col("x")
    return rows.select(*PAIR, "ts", "pos", "n", (F.col("y") - line).alias(value))


def candidates(closes: DataFrame, gate: Column, min_rows: int, seconds: int, rank: DataFrame | None = None):
    """Statistics of the pairs that pass ``gate``, and their numbered residuals.

    All-pair statistics come from the block products; only passing pairs get rows. Both are
    written once because the tests below read them more than once.
    """
    moments = pairs.pair_moments(closes, min_rows=min_rows, rank=rank)
    lines = stage(pairs.hedge_stats(moments).where(gate), "lines")
    rows = pairs.pair_bars(closes, lines.select(*PAIR, "n", "alpha", "beta"))
    numbered = with_position(rows, PAIR, ["ts"], "pos", seconds)
    return lines, stage(residuals_of(numbered), "residuals")


def within(
    ranked: DataFrame,
    min_corr: float | None = None,
    max_p: float | None = None,
    half_life_range: tuple[float, float] | None = None,
    corr: str = "corr",
    p: str = "p_value",
    half_life: str = "half_life",
) -> DataFrame:
    """Threshold filters over published (already rounded) values; a null fails."""
    if min_corr is not None:
        ranked = ranked.where(F.col(corr) >= min_corr)
    if max_p is not None:
        ranked = ranked.where(F.col(p) < max_p)
    if half_life_range is not None:
        low, high = half_life_range
        ranked = ranked.where((F.col(half_life) > low) & (F.col(half_life) < high))
    return ranked


def pair_scan(
    closes: DataFrame,
    min_rows: int = 1000,
    min_corr: float = 0.8,
    max_p: float = 0.05,
    half_life_range: tuple[float, float] = (5, 1000),
    tail_rows: int | None = None,
    rank: DataFrame | None = None,
    seconds: int = MONTH,
    block_rows: int = BLOCK_ROWS,
    wide: bool = False,
) -> DataFrame:
    """Pairs with a cointegrated, quickly reverting spread, best p-value first.

    Values are rounded before the thresholds apply. For many series that each fit a record set ``wide``: residuals are then
    made, tested and left behind in tiles, and only pairs that may pass are written. A rank that names a symbol several
    times has several series for it, which tiles don't know.
    """
    if tail_rows is not None:
        closes = stage(windows.tail_n(closes, tail_rows, seconds=seconds), "tails")
    if wide and (rank is None or not rank.groupBy("symbol").count().where("symbol is not null and count > 1").limit(1).count()):
        # Thresholds apply to rounded values, so the tiles' own are wider.
        speeds = (half_life_range[0] - BARS_ROUNDING, half_life_range[1] + BARS_ROUNDING)
        passing = tiles.gated_tests(closes, min_rows=min_rows, min_corr=min_corr, max_p=max_p + P_ROUNDING, half_life_range=speeds, rank=rank)
        # Sorting samples its input first: written, it is worked out once.
        tested = pairs.hedge_stats(stage(passing, "tested"))
    else:
        gate = (F.col("n") >= min_rows) & (F.col("corr") >= min_corr)
        lines, numbered = candidates(closes, gate, min_rows, seconds, rank)
        speed = stats.half_life(numbered, block_rows=block_rows)
        tested = stats.coint(numbered, lines, block_rows).join(speed, PAIR, "left")
    published = tested.select(
        F.col("leg_1").alias("Leg_1"),
        F.col("leg_2").alias("Leg_2"),
        F.round("corr", 3).alias("Correlation"),
        F.round("p_value", 5).alias("Coint_Pvalue"),
        F.round("half_life", 1).alias("Half_Life_Bars"),
        F.round("beta", 3).alias("Hedge_Ratio"),
    )
    kept = within(
        published, None, max_p, half_life_range, p="Coint_Pvalue", half_life="Half_Life_Bars"
    )
    return kept.orderBy("Coint_Pvalue", "Leg_1", "Leg_2")


def vol_scan(
    closes: DataFrame,
    min_corr: float = 0.8,
    max_p: float = 0.05,
    k: int = 10,
    seconds: int = MONTH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cointegrated pairs with the widest residuals relative to price, over common timestamps."""
    shared = stage(align.align_inner_all(closes).select("symbol", "ts", "close"), "shared")
    lines, numbered = candidates(shared, F.col("corr") >= min_corr, 2, seconds)
    tested = stats.coint(numbered, lines, block_rows).where(F.col("p_value") <= max_p)
    found = tested.select(
        F.col("leg_1").alias("Leg1"),
        F.col("leg_2").alias("Leg2"),
        F.col("corr").alias("Corr"),
        F.col("p_value").alias("P_Value"),
        F.col("vol_pct").alias("Vol_Pct"),
    )
    return windows.top_k(found, k, [F.desc("Vol_Pct"), "Leg1", "Leg2"])


def stationary_scan(
    closes: DataFrame, alpha: float = 0.05, seconds: int = MONTH, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every pair in both directions over common timestamps, with the unit-root verdict."""
    shared = stage(align.align_inner_all(closes).select("symbol", "ts", "close"), "shared")
    both = pairs.both_directions(pairs.pair_moments(shared))
    lines = stage(pairs.hedge_stats(both), "lines")
    rows = pairs.pair_bars(shared, lines.select(*PAIR, "n", "alpha", "beta"))
    numbered = stage(residuals_of(with_position(rows, PAIR, ["ts"], "pos", seconds)), "residuals")
    return (
        stats.adf(numbered, block_rows=block_rows)
        .join(lines.select(*PAIR, "beta"), PAIR)
        .select(
            F.concat_ws("-", *PAIR).alias("Pair"),
            F.col("beta").alias("Hedge_Ratio"),
            F.col("p_value").alias("P_Value"),
            (F.col("p_value") < alpha).alias("Stationary"),
        )
    )


def cointegrated_pairs(
    closes: DataFrame, min_corr: float = 0.8, max_p: float = 0.05, seconds: int = MONTH, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs to trade, over common timestamps: correlation and cointegration gates."""
    lines, numbered = candidates(closes, F.col("corr") >= min_corr, 2, seconds)
    return stats.coint(numbered, lines, block_rows).where(F.col("p_value") < max_p).select(*PAIR)
