"""Normalising, de-duplicating, filtering and patching of bars and ticks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.sources.schemas import BAR_COLUMNS

# Vendor short names and the currencies both legs of a liquid FX ticker come from.
VENDOR_NAMES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap"}
LIQUID_CURRENCIES = [
    "USD", "EUR", "JPY", "GBP", "AUD", "CAD", "CHF",
    "NZD", "SGD", "HKD", "SEK", "NOK", "MXN", "ZAR",
]


def normalize_bars(
    df: DataFrame,
    names: dict[str, str] | None = None,
    expected: Sequence[str] = BAR_COLUMNS,
    keep: Sequence[str] = ("symbol", "ts"),
    fill: float = 0.0,
) -> DataFrame:
    """Rename vendor columns and add the expected ones that are absent as ``fill``.

    Only absent columns are filled; null values in present columns stay null.
    """
    renamed = df.withColumnsRenamed(VENDOR_NAMES if names is None else names)
    present = set(renamed.columns)
    bars = [F.col(c) if c in present else F.lit(fill).alias(c) for c in expected]
    return renamed.select(*[c for c in keep if c in present], *bars)


def known(value: str | Column) -> Column:
    """Whether a value is there: neither null nor NaN."""
    v = F.col(value) if isinstance(value, str) else value
    return v.isNotNull() & ~F.isnan(v)


def nan_to_null(df: DataFrame, cols: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    """NaN becomes null in those of ``cols`` that ``df`` has, so that statistics skip it."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols if c in df.columns})


def epoch_ms(col: str | Column) -> Column:
    return F.timestamp_millis(F.col(col) if isinstance(col, str) else col)


def dedupe(df: DataFrame, keys: Sequence[str], seq: str, keep: str = "last") -> DataFrame:
    """One row per ``keys``: the one that arrived last or first by ``seq``, unique per key.

    An aggregate, not a ranking window: copies are merged on the map side, so a key with a huge
    group of copies costs no more than any other, and column by column so that the aggregate
    stays hash-based.
    """
    pick, bound = {"last": (F.max_by, F.max), "first": (F.min_by, F.min)}[keep]
    rest = [bound(c).alias(c) if c == seq else pick(c, seq).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*rest).select(*df.columns)


def liquid_tickers(
    df: DataFrame, ticker: str = "ticker", currencies: Iterable[str] = LIQUID_CURRENCIES
) -> DataFrame:
    """Keep ``C:XXXYYY`` tickers whose base and quote are both liquid."""
    name = F.col(ticker)
    club = list(currencies)
    return df.where(
        (F.length(name) == 8)
        & name.startswith("C:")
        & F.substring(name, 3, 3).isin(club)
        & F.substring(name, 6, 3).isin(club)
    )


def valid_price(price: str = "price") -> Column:
    return F.col(price).isNotNull() & ~F.isnan(price) & (F.col(price) > 0)


def valid_ticks(ticks: DataFrame, instruments: DataFrame, price: str = "price") -> DataFrame:
    """Drop unusable prices and ticks of unknown instruments, and name the instrument.

    The join carries no hint: Spark broadcasts the dimension when its measured size allows and
    shuffles otherwise. Over a stream it keeps no state.
    """
    return ticks.where(valid_price(price)).join(instruments.select("con_id", "key"), "con_id")


def clip_backfill(
    df: DataFrame, start, asset_type: str = "asset_type", supported: Sequence[str] = ("STK", "CASH")
) -> DataFrame:
    """Rows of supported asset types from ``start`` on."""
    return df.where(F.col(asset_type).isin(list(supported)) & (F.col("ts") >= F.lit(start).cast("timestamp")))


def price_type(asset_type: str | Column) -> Column:
    """Price kind to ask for: FX has no trades, so midpoints."""
    kind = F.col(asset_type) if isinstance(asset_type, str) else asset_type
    return F.when(kind == "CASH", F.lit("MIDPOINT")).otherwise(F.lit("TRADES"))


def range_upsert(
    target: DataFrame, patch: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Replace, per key, the whole time range that ``patch`` covers, then add the patch.

    Target rows inside the range but absent from the patch disappear. The bounds are one row per
    key; running it twice changes nothing.
    """
    keys = list(keys)
    bounds = patch.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    outside = F.col("_lo").isNull() | (F.col(ts) < F.col("_lo")) | (F.col(ts) > F.col("_hi"))
    kept = target.join(bounds, keys, "left").where(outside).select(*target.columns)
    return kept.unionByName(patch.select(*target.columns))
