"""Strategy signals with their orders, the ledger they leave, and the gate before execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.operators.align import asof_join
from tidepair.operators.ordered import MONTH, with_neighbour
from tidepair.operators.pairs import PAIR
from tidepair.operators.windows import rolling_z

# Signal names of the strategies.
ENTRY_LONG_SPREAD, ENTRY_SHORT_SPREAD, EXIT_ALL = "ENTRY_LONG_SPREAD", "ENTRY_SHORT_SPREAD", "EXIT_ALL"
ENTRY_LONG, ENTRY_SHORT, DEMO_ENTRY, HOLD = "ENTRY_LONG", "ENTRY_SHORT", "DEMO_ENTRY", "HOLD"
STRATEGY_SIGNALS = [ENTRY_LONG_SPREAD, ENTRY_SHORT_SPREAD, EXIT_ALL, ENTRY_LONG, ENTRY_SHORT, DEMO_ENTRY]


def order(key: str | Column, action: str | Column, qty: Column, kind: str = "MKT") -> Column:
    """One order instruction as a struct."""
    as_col = lambda v: F.col(v) if isinstance(v, str) else v
    side = F.lit(action) if isinstance(action, str) else action
    return F.struct(
        as_col(key).alias("key"),
        side.alias("action"),
        qty.cast("double").alias("qty"),
        F.lit(kind).alias("type"),
    )


def signal_flags(df: DataFrame, entry: float, exit_band: float, z: str = "z_score") -> DataFrame:
    return (
        df.withColumn("long_signal", F.col(z) < -entry)
        .withColumn("short_signal", F.col(z) > entry)
        .withColumn("exit_signal", F.abs(z) < exit_band)
    )


def kalman_signals(events: DataFrame, qty: float = 10, track_entry_qty: bool = False) -> DataFrame:
    """Orders for position events that carry ``beta``, ``y``, ``x`` and ``error``.

    The hedge leg is the whole part of ``qty * |beta|`` with the slope of that bar, at exit as
    well as at entry; ``track_entry_qty`` closes the quantity that was opened instead. Expects
    the events of one rule.
    """
    slope = F.col("beta")
    if track_entry_qty:
        events = with_neighbour(events, PAIR, ["ts"], {"_opened": "beta"})
        slope = F.when(F.col("is_exit"), F.col("_opened")).otherwise(slope)
    entering, long = ~F.col("is_exit"), F.col("side") > 0
    kind = (
        F.when(F.col("is_exit"), F.lit(EXIT_ALL))
        .when(long, F.lit(ENTRY_LONG_SPREAD))
        .otherwise(F.lit(ENTRY_SHORT_SPREAD))
    )
    buys_y = entering == long
    buy_sell = lambda buy: F.when(buy, F.lit("BUY")).otherwise(F.lit("SELL"))
    hedge = (F.lit(qty) * F.abs(slope)).cast("bigint")
    return events.select(
        *PAIR,
        "ts",
        kind.alias("signal_type"),
        F.array(
            order("leg_1", buy_sell(buys_y), F.lit(qty)),
            order("leg_2", buy_sell(~buys_y), hedge),
        ).alias("orders"),
        F.create_map(
            F.lit("z_score"), F.col("z_score"),
            F.lit("beta"), F.col("beta"),
            F.lit("predicted_y"), F.col("y") - F.col("error"),
            F.lit("error"), F.col("error"),
        ).alias("meta"),
        "y",
        "x",
    )


def mean_reversion_signals(
    pairs: DataFrame,
    hedge_ratio: float,
    window: int = 30,
    threshold: float = 2.0,
    qty: float = 10,
    min_obs: int = 20,
    keys: Sequence[str] = PAIR,
) -> DataFrame:
    """Entry signals on every bar whose spread is far from its trailing mean (population
    deviation, at least ``min_obs`` rows); no position is kept and no exit is given."""
    spread = pairs.withColumn("spread", F.col("y") - F.lit(hedge_ratio) * F.col("x"))
    scored = rolling_z(spread, keys, "spread", window, ddof=0, min_obs=min_obs, out="z_score")
    low, high = F.col("z_score") < -threshold, F.col("z_score") > threshold
    hedge = F.lit(int(qty * hedge_ratio))
    side = lambda buy: F.when(buy, F.lit("BUY")).otherwise(F.lit("SELL"))
    return scored.where(low | high).select(
        *keys,
        "ts",
        F.when(low, F.lit(ENTRY_LONG)).otherwise(F.lit(ENTRY_SHORT)).alias("signal_type"),
        F.array(order("leg_1", side(low), F.lit(qty)), order("leg_2", side(~low), hedge)).alias("orders"),
        F.create_map(
            F.lit("z_score"), F.col("z_score"), F.lit("spread"), F.col("spread")
        ).alias("meta"),
        "y",
        "x",
    )


def ratio_signals(pairs: DataFrame, threshold: float = 1000.0, qty: float = 10) -> DataFrame:
    """Buy the first leg and sell the second while their price ratio is above the threshold."""
    ratio = F.try_divide("y", "x")
    return (
        pairs.withColumn("ratio", ratio)
        .where(F.col("ratio") > threshold)
        .select(
            *PAIR,
            "ts",
            F.lit(DEMO_ENTRY).alias("signal_type"),
            F.array(order("leg_1", "BUY", F.lit(qty)), order("leg_2", "SELL", F.lit(qty))).alias("orders"),
            F.create_map(F.lit("ratio"), F.col("ratio")).alias("meta"),
            "y",
            "x",
        )
    )


def trade_ledger(signals: DataFrame) -> DataFrame:
    """One row per order, filled at its own bar's price."""
    ordered = signals.withColumn("o", F.explode("orders"))
    price = F.when(F.col("o.key") == F.col("leg_1"), F.col("y")).otherwise(F.col("x"))
    return ordered.select(
        F.col("ts").alias("time"),
        F.col("signal_type").alias("signal"),
        F.col("o.key").alias("asset"),
        F.col("o.action").alias("action"),
        F.col("o.qty").alias("qty"),
        price.alias("price"),
        "meta",
    )


def price_ledger(orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Fill orders ``(ts, key, ...)`` at the aligned price of their instrument and bar."""
    fills = prices.select(F.col("symbol").alias("key"), "ts", F.col("close").alias("price"))
    return orders.join(fills, ["key", "ts"])


def standing_ledger(orders: DataFrame, prices: DataFrame, seconds: int = MONTH) -> DataFrame:
    """Fill orders ``(ts, key, ...)`` at the last price of their instrument known by then.

    ``prices`` are the bars as they came, not the filled grid: the price that stands when an order
    is given is carried over from the chunk before where need be. Orders before an instrument's
    first price are not filled.
    """
    asked = orders.select(F.col("key").alias("symbol"), "ts").distinct()
    standing = asof_join(prices, asked, seconds=seconds).where(F.col("close").isNotNull())
    return price_ledger(orders, standing)


def pair_orders(signals: DataFrame, qty: float, hedge_qty: float) -> DataFrame:
    """``(ts, signal, key, action, qty)``: both legs' orders of entry signals and of their exits.

    A long buys the first leg and sells the second; ``EXIT_ALL`` of a side undoes its entry.
    """
    if "side" not in signals.columns:
        signals = signals.withColumn("side", F.lit(0))
    long = (F.col("signal_type") == ENTRY_LONG) | ((F.col("signal_type") == EXIT_ALL) & (F.col("side") < 0))
    word = lambda buy: F.when(buy, F.lit("BUY")).otherwise(F.lit("SELL"))
    legs = F.array(order("leg_1", word(long), F.lit(qty)), order("leg_2", word(~long), F.lit(hedge_qty)))
    rows = signals.withColumn("o", F.explode(legs))
    return rows.select("ts", F.col("signal_type").alias("signal"), F.col("o.key").alias("key"), F.col("o.action").alias("action"), F.col("o.qty").alias("qty"))


def allowed(signals: DataFrame, allow: Sequence[str] = STRATEGY_SIGNALS) -> DataFrame:
    """Known, non-null signals other than HOLD."""
    return signals.where(_passes(allow))


def rejected(signals: DataFrame, allow: Sequence[str] = STRATEGY_SIGNALS) -> DataFrame:
    return signals.where(~_passes(allow))


def _passes(allow: Sequence[str]) -> Column:
    kind = F.col("signal_type")
    return F.coalesce(kind.isin([a for a in allow if a != HOLD]), F.lit(False))


def order_intents(signals: DataFrame, kinds: Sequence[str] = ("MKT",)) -> tuple[DataFrame, DataFrame]:
    """Routable orders and, second, those of a type that is not supported."""
    flat = signals.withColumn("o", F.explode("orders")).select(
        *PAIR,
        "ts",
        "signal_type",
        F.col("o.key").alias("asset"),
        F.col("o.action").alias("action"),
        F.col("o.qty").alias("qty"),
        F.col("o.type").alias("type"),
    )
    routable = F.col("type").isin(list(kinds))
    return flat.where(routable), flat.where(~routable)


def instrument_of(contracts: DataFrame, instruments: DataFrame) -> DataFrame:
    """First instrument key (by catalogue position) that matches each contract symbol."""
    first = instruments.groupBy("contract").agg(F.min_by("key", "position").alias("key"))
    return contracts.join(first, "contract", "left")


def z_zone(z: str | Column, limit: float = 2.0) -> Column:
    """Display zone of a z-score."""
    v = F.col(z) if isinstance(z, str) else z
    return F.when(v > limit, F.lit("inverse")).when(v < -limit, F.lit("off")).otherwise(F.lit("normal"))
