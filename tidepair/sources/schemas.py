"""Fixed schemas, one per table."""

from pyspark.sql import types as T

BAR_COLUMNS = ["open", "high", "low", "close", "volume", "vwap"]

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)

# Vendor aggregates as landed: short or long names, epoch milliseconds, some columns may be missing.
VENDOR_BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("o", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("l", T.DoubleType()),
        T.StructField("c", T.DoubleType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("vw", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS],
        T.StructField("ingest_seq", T.LongType()),
    ]
)

BROKER_BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

TICKER_CATALOG = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("active", T.BooleanType()),
    ]
)

MONITOR = T.StructType(
    [
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("ASSET_A", T.DoubleType()),
        T.StructField("ASSET_B", T.DoubleType()),
        T.StructField("Spread", T.DoubleType()),
        T.StructField("Z-Score", T.DoubleType()),
    ]
)

EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
