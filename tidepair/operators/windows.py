"""Gaps, returns, rolling z-scores, row tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepair.operators.ordered import (
    BLOCK_ROWS,
    CHUNK,
    CHUNK_ROWS,
    DAY,
    MONTH,
    keyed_chunk,
    with_neighbour,
    with_rolling,
)


def gap_delta(
    df: DataFrame, keys: Sequence[str] = ("symbol",), seconds: int = MONTH, max_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """Time since the previous row of the symbol, one row for each of ``df``: ``prev_ts`` and ``gap_us``.

    Copies of a timestamp are merged before the shuffle and taken apart behind it: the first one
    follows the timestamp before, the others follow a copy, with a gap of 0.
    """
    times = df.select(*keys, "ts")
    counted = times.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_copies"))
    previous = with_neighbour(counted, list(keys), ["ts"], {"prev_ts": "ts"}, seconds, max_rows=max_rows, edges=times)
    before = F.when(F.col("_copies") == 1, F.array("prev_ts")).otherwise(
        F.concat(F.array("prev_ts"), F.array_repeat("ts", (F.col("_copies") - 1).cast("int")))
    )
    rows = previous.withColumn("prev_ts", F.explode(before)).select(*keys, "ts", "prev_ts")
    return rows.withColumn("gap_us", F.unix_micros("ts") - F.unix_micros("prev_ts"))


def gap_report(
    df: DataFrame,
    threshold_seconds: int = 300,
    alert_seconds: int = 4 * DAY,
    keys: Sequence[str] = ("symbol",),
    seconds: int = MONTH,
) -> DataFrame:
    """Gaps longer than the threshold, from the last bar before to the first bar after."""
    return (
        gap_delta(df, keys, seconds)
        .where(F.col("gap_us") > threshold_seconds * 1_000_000)
        .select(
            *keys,
            F.col("prev_ts").alias("gap_start"),
            F.col("ts").alias("gap_end"),
            (F.col("gap_us") / 1_000_000).alias("duration_s"),
            (F.col("gap_us") > alert_seconds * 1_000_000).alias("suspicious"),
        )
    )


def gap_verdict(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.count_if("suspicious").alias("n_suspicious"),
        F.coalesce(F.bool_or("suspicious"), F.lit(False)).alias("alert"),
    )


def pct_change(df: DataFrame, value: str = "close", out: str = "ret", seconds: int = MONTH) -> DataFrame:
    """Relative change from the previous row of the symbol; the first row is dropped."""
    before = with_neighbour(df.select("symbol", "ts", value), ["symbol"], ["ts"], {"_p": value}, seconds)
    return before.where(F.col("_p").isNotNull()).select(
        "symbol", "ts", (F.col(value) / F.nullif(F.col("_p"), F.lit(0.0)) - 1).alias(out)
    )


def rolling_z(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "spread",
    n: int = 30,
    ddof: int = 1,
    min_obs: int | None = None,
    out: str = "rolling_z",
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """z of ``value`` against its trailing ``n`` rows, current row included; null until
    ``min_obs`` rows (default ``n``) are there or while they do not vary."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    need = n if min_obs is None else min_obs
    specs = {
        "_n": lambda w: F.count(value).over(w),
        "_m": lambda w: F.avg(value).over(w),
        "_s": lambda w: std(value).over(w),
    }
    z = (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    rolled = with_rolling(df, list(keys), pos, n, specs, block_rows)
    return rolled.withColumn(out, F.when(F.col("_n") >= need, z)).drop("_n", "_m", "_s")


def demean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Value minus the mean of its key: one aggregate joined back, not a whole-key window."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return df.join(mean, list(keys)).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def _edge_rows(df: DataFrame, n: int, keys: Sequence[str], seconds: int, last: bool) -> DataFrame:
    """The ``n`` rows of each key at one end of time.

    Rows are counted by key and chunk; only chunks that fewer than ``n`` rows lie beyond can hold
    one of them, and only their rows are numbered.
    """
    side = F.desc if last else F.asc
    rows = keyed_chunk(df, keys, "ts", seconds)
    beyond = Window.partitionBy(*keys).orderBy(side(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    reached = counts.withColumn("_beyond", F.coalesce(F.sum("_rows").over(beyond), F.lit(0)))
    kept = reached.where(F.col("_beyond") < n).select(*keys, CHUNK, "_beyond")
    local = Window.partitionBy(*keys, CHUNK).orderBy(side("ts"))
    numbered = rows.join(kept, [*keys, CHUNK]).withColumn("_pos", F.row_number().over(local) + F.col("_beyond"))
    return numbered.where(F.col("_pos") <= n).select(*df.columns)


def tail_n(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",), seconds: int = MONTH) -> DataFrame:
    """Last ``n`` rows of each key, by row and not by time."""
    return _edge_rows(df, n, list(keys), seconds, True)


def head_n(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",), seconds: int = MONTH) -> DataFrame:
    """First ``n`` rows of each key."""
    return _edge_rows(df, n, list(keys), seconds, False)


def top_k(df: DataFrame, k: int, by: Sequence[Column | str]) -> DataFrame:
    """The first ``k`` rows in the given order, kept as a bounded heap per task."""
    return df.orderBy(*by).limit(k)


def top_bottom_k(df: DataFrame, k: int, metric: str, tie: str) -> DataFrame:
    """The ``k`` best and the ``k`` worst rows; a row that is both appears twice."""
    best = top_k(df, k, [F.desc(metric), F.asc(tie)]).withColumn("side", F.lit("top"))
    worst = top_k(df, k, [F.asc(metric), F.desc(tie)]).withColumn("side", F.lit("bottom"))
    return best.unionAll(worst)
