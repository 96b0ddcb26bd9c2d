"""From trades to costs, grids, position sizes, portfolio curves and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.operators.ordered import MONTH, with_drawdown, with_running_sum
from tidepair.operators.pairs import PAIR

# One-way commission and slippage per share.
COMMISSION = 0.005
SLIPPAGE = 0.01


def round_trip_cost(
    shares_y: float, shares_x: float, commission: float = COMMISSION, slippage: float = SLIPPAGE
) -> float:
    """Cost of entering and leaving both legs."""
    return (shares_y + shares_x) * (commission + slippage) * 2


def break_even(beta: float | Column, commission: float = COMMISSION, slippage: float = SLIPPAGE):
    """Round-trip cost per spread unit: one share of y and beta shares of x."""
    return (commission + slippage) * 2 * (1 + beta)


def cost_band(df: DataFrame, beta: float, keys: Sequence[str] = PAIR) -> DataFrame:
    """Deviation of a static-beta spread from its mean, and whether costs swallow it."""
    spread = df.withColumn("_spread", F.col("y") - beta * F.col("x"))
    mean = spread.groupBy(*keys).agg(F.avg("_spread").alias("_mean"))
    band = F.lit(break_even(beta))
    return (
        spread.join(mean, list(keys))
        .withColumn("deviation", F.col("_spread") - F.col("_mean"))
        .withColumn("inside_cost", F.abs("deviation") <= band)
        .drop("_spread", "_mean")
    )


def completed(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("pnl") != 0)


def trade_stats(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Win rate, average win and loss, reward to risk over completed trades."""
    won, lost = F.col("pnl") > 0, F.col("pnl") <= 0
    stats = completed(trades).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(won).alias("n_wins"),
        F.avg(F.when(won, F.col("pnl"))).alias("avg_win"),
        F.abs(F.avg(F.when(lost, F.col("pnl")))).alias("avg_loss"),
    )
    return stats.withColumn("win_rate", F.try_divide(F.col("n_wins"), F.col("n_trades"))).withColumn(
        "reward_risk", F.try_divide("avg_win", "avg_loss")
    )


def kelly(stats: DataFrame) -> DataFrame:
    """Kelly fraction, its half, and whether to trade at all."""
    fraction = F.col("win_rate") - F.try_divide(1 - F.col("win_rate"), F.col("reward_risk"))
    return (
        stats.withColumn("kelly", fraction)
        .withColumn("half_kelly", F.col("kelly") * 0.5)
        .withColumn("tradable", F.coalesce(F.col("half_kelly") > 0, F.lit(False)))
    )


def position_size(sized: DataFrame, last_bars: DataFrame, capital: float, keys: Sequence[str] = PAIR) -> DataFrame:
    """Whole shares of both legs from the allocation and the last bar ``(y, x, beta)``."""
    shares_y = (F.lit(capital) * F.col("half_kelly") / F.col("y")).cast("bigint")
    return (
        sized.where("tradable")
        .join(last_bars, list(keys))
        .withColumn("shares_y", shares_y)
        .withColumn("shares_x", (F.col("shares_y") * F.col("beta")).cast("bigint"))
    )


def last_bar(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, "ts").alias(c) for c in cols])


def with_grid(df: DataFrame, **lists: Sequence[float]) -> DataFrame:
    """Every row of ``df`` once per combination of the given parameter lists.

    The lists are literals in the plan and are exploded in place, so nothing is joined or shuffled.
    """
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def grid_summary(
    events: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    shares: float,
    cost: float,
) -> DataFrame:
    """Trades, gross and net PnL per grid row; combinations without a trade stay with zeros."""
    done = events.where("is_exit").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_trades"), F.sum(F.col("points") * shares).alias("_gross")
    )
    trades, gross = F.coalesce("_trades", F.lit(0)), F.coalesce("_gross", F.lit(0.0))
    net = gross - trades * cost
    return grid.join(done, list(keys), "left").select(
        *grid.columns,
        trades.alias("trades"),
        gross.alias("gross_pnl"),
        net.alias("net_pnl"),
        F.when(trades > 0, net / trades).otherwise(F.lit(0.0)).alias("avg_net_per_trade"),
    )


def best_config(summary: DataFrame, order: Sequence[Column | str], min_trades: int = 10) -> DataFrame:
    """First row of the ranking with its verdict."""
    verdict = (
        F.when((F.col("net_pnl") > 0) & (F.col("trades") > min_trades), F.lit("winner"))
        .when(F.col("net_pnl") > 0, F.lit("low_volume"))
        .otherwise(F.lit("failed"))
    )
    return summary.orderBy(*order).limit(1).withColumn("verdict", verdict)


def gross_net_curve(
    trades: DataFrame, keys: Sequence[str], shares: float, cost: float, seconds: int = MONTH
) -> DataFrame:
    """Running gross and net dollars over completed trades."""
    return with_running_sum(
        completed(trades),
        list(keys),
        ["ts"],
        {"gross_pnl": F.col("pnl") * shares, "net_pnl": F.col("pnl") * shares - cost},
        seconds,
    )


def pnl_by_ts(pnl: DataFrame) -> DataFrame:
    """Portfolio PnL per timestamp over all pairs; stays long where others go wide."""
    return pnl.groupBy("ts").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n_pairs"))


#: Timestamps of a portfolio curve that one task sorts.
CURVE_ROWS = 500_000


def equity_curve(pnl: DataFrame, seconds: int = MONTH) -> DataFrame:
    """Portfolio equity, running peak and drawdown over time. All timestamps are one series, so a
    chunk of it may be dense; it is cut where it holds more than ``CURVE_ROWS`` of them."""
    return with_drawdown(pnl_by_ts(pnl).select("ts", "pnl"), [], ["ts"], "pnl", seconds, CURVE_ROWS)


def attribution(pnl: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return pnl.groupBy(*keys).agg(
        F.sum("pnl").alias("net_pnl"), F.count_if(F.col("pnl") != 0).alias("trades")
    )


def scorecard(pnl: DataFrame, keys: Sequence[str] = PAIR, min_pairs: int = 5, seconds: int = MONTH) -> DataFrame:
    """Total PnL, deepest drawdown, winning pairs and the diversification flag, as one row."""
    per_pair = attribution(pnl, keys).agg(
        F.count_if(F.col("net_pnl") > 0).alias("winning_pairs"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("net_pnl").alias("total_pnl"),
    )
    deepest = equity_curve(pnl, seconds).agg(F.min("drawdown").alias("max_drawdown"))
    return per_pair.select(
        "total_pnl",
        deepest.scalar().alias("max_drawdown"),
        "winning_pairs",
        "n_pairs",
        (F.col("n_pairs") > min_pairs).alias("diversified"),
    )
