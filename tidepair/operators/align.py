"""Resampling, alignment of many series, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepair.operators.clean import known
from tidepair.operators.ordered import CHUNK, CHUNK_ROWS, MONTH, add_chunk, order_key, with_last_known


def resample_last(
    df: DataFrame, width: str, value: str = "close", order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Last non-null value per symbol and bucket, labelled by the bucket's left edge.

    Empty buckets are absent. The aggregate merges on the map side, so ticks of a hot symbol
    shrink to one row per bucket before the shuffle.
    """
    return (
        df.where(known(value))
        .groupBy("symbol", F.window("ts", width).alias("_w"))
        .agg(F.max_by(value, order_key(order)).alias(value))
        .select("symbol", F.col("_w.start").alias("ts"), value)
    )


def ohlc_bars(
    ticks: DataFrame, width: str, price: str = "price", order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Open, high, low, close, tick count and mean price per symbol and bucket."""
    at = order_key(order)
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("_w"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.count(price).cast("double").alias("volume"),
            F.avg(price).alias("vwap"),
        )
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap")
    )


def align_inner_all(df: DataFrame, value: str = "close") -> DataFrame:
    """Rows at timestamps where every symbol of ``df`` has a value; stays long, no pivot. Copies
    of a row stay, but count once."""
    valued = df.where(known(value))
    wanted = valued.agg(F.count_distinct("symbol").alias("n"))
    full = (
        valued.groupBy("ts")
        .agg(F.count_distinct("symbol").alias("_n"))
        .where(F.col("_n") == wanted.scalar())
        .select("ts")
    )
    return valued.join(full, "ts", "left_semi")


def align_outer_ffill(df: DataFrame, value: str = "close", seconds: int = MONTH) -> DataFrame:
    """Every symbol at every timestamp of any symbol, forward filled, from the moment all
    symbols have a price.

    The grid comes from an equi-join on the time chunk: each symbol contributes one row per chunk
    (with the price it enters the chunk with) and meets the chunk's distinct timestamps.
    """
    valued = add_chunk(df.where(known(value)), "ts", seconds).select("symbol", "ts", CHUNK, value)
    times = valued.select(CHUNK, "ts").distinct()
    per_chunk = valued.groupBy("symbol", CHUNK).agg(F.max_by(value, "ts").alias("_last"))
    ahead = Window.partitionBy("symbol").orderBy(CHUNK)
    final = valued.agg(F.max(CHUNK).alias("c"))
    # One row per symbol and chunk from its first chunk on, holding the price on entry.
    entry = (
        per_chunk.withColumn("_next", F.lead(CHUNK).over(ahead))
        .withColumn("_before", F.lag("_last").over(ahead))
        .withColumn("_end", F.coalesce(F.col("_next") - 1, final.scalar()))
        .select(
            "symbol",
            F.posexplode(F.sequence(CHUNK, "_end")).alias("_i", CHUNK),
            F.when(F.col("_i") == 0, F.col("_before")).otherwise(F.col("_last")).alias("_entry"),
        )
    )
    grid = times.join(entry, CHUNK).join(valued.drop(CHUNK), ["symbol", "ts"], "left")
    upto = Window.partitionBy("symbol", CHUNK).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(upto), F.col("_entry"))
    starts = valued.groupBy("symbol").agg(F.min("ts").alias("t")).agg(F.max("t").alias("t"))
    return grid.select("symbol", "ts", filled.alias(value)).where(F.col("ts") >= starts.scalar())


def ready_timestamps(df: DataFrame, n_instruments: int | None = None, value: str = "close") -> DataFrame:
    """Timestamps from which every instrument has had a price."""
    firsts = df.where(known(value)).groupBy("symbol").agg(F.min("ts").alias("t"))
    gate = firsts.agg(F.max("t").alias("ready_ts"), F.count(F.lit(1)).alias("n"))
    if n_instruments is not None:
        gate = gate.where(F.col("n") == n_instruments)
    ready = gate.select("ready_ts")
    return df.select("ts").distinct().where(F.col("ts") >= ready.scalar())


def align_left(left: DataFrame, right: DataFrame, on: str = "ts") -> DataFrame:
    """Right column on the left index; missing matches are null."""
    return left.join(right, on, "left")


def asof_value(df: DataFrame, probe, value: str = "close") -> DataFrame:
    """Per symbol, the last non-null row at or before one timestamp."""
    earlier = df.where((F.col("ts") <= F.lit(probe).cast("timestamp")) & known(value))
    return earlier.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by(value, "ts").alias(value))


def asof_join(
    df: DataFrame, probes: DataFrame, value: str = "close", seconds: int = MONTH, max_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """For each (symbol, ts) probe, the last known value at or before it.

    Probes may be raw events: chunks of more than ``max_rows`` rows are cut further.
    """
    rows = df.where(known(value)).select("symbol", "ts", value, F.lit(0).alias("_probe"))
    asks = probes.select(
        "symbol", "ts", F.lit(None).cast(df.schema[value].dataType).alias(value), F.lit(1).alias("_probe")
    )
    merged = rows.unionByName(asks)
    return (
        with_last_known(merged, ["symbol"], ["ts", "_probe"], {value: value}, seconds, max_rows)
        .where(F.col("_probe") == 1)
        .select("symbol", "ts", value)
    )


def exact_and_next(df: DataFrame, at) -> DataFrame:
    """The row at exactly ``at`` with its successor's time and close, per symbol."""
    moment = F.lit(at).cast("timestamp")
    exact = df.where(F.col("ts") == moment).select("symbol", "ts", "close")
    following = (
        df.where(F.col("ts") > moment)
        .groupBy("symbol")
        .agg(F.min("ts").alias("next_ts"), F.min_by("close", "ts").alias("next_close"))
    )
    return exact.join(following, "symbol", "left")


def nearby(df: DataFrame, at, before: str = "1 day", after: str = "1 day") -> DataFrame:
    """Rows around a timestamp that has no exact match."""
    mid = F.lit(at).cast("timestamp")
    return df.where(
        (F.col("ts") >= mid - F.expr(f"INTERVAL {before}")) & (F.col("ts") <= mid + F.expr(f"INTERVAL {after}"))
    )


def to_wide(df: DataFrame, symbols: Sequence[str], value: str = "close") -> DataFrame:
    """One column per named symbol, for the edge of a pipeline; the operators stay long."""
    return df.groupBy("ts").pivot("symbol", list(symbols)).agg(F.first(value))
