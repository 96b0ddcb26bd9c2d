"""Bar-series library: one long table, stored as parquet partitioned by symbol."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepair.operators.clean import VENDOR_NAMES, nan_to_null
from tidepair.operators.ordered import DAY, chunk_of
from tidepair.session import use_utc
from tidepair.sources.schemas import BARS, BROKER_BARS, MONITOR, TICKER_CATALOG, VENDOR_BARS

Bound = str | date | datetime


def slice_time(
    df: DataFrame,
    start: Bound | None = None,
    end: Bound | None = None,
    end_day_inclusive: bool = False,
    ts: str = "ts",
) -> DataFrame:
    """Inclusive time slice. A bare end date means its midnight unless ``end_day_inclusive``,
    which keeps that whole day."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        last = F.lit(end).cast("timestamp")
        if end_day_inclusive:
            df = df.where(F.col(ts) < F.date_trunc("day", last) + F.expr("INTERVAL 1 DAY"))
        else:
            df = df.where(F.col(ts) <= last)
    return df


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(use_utc(spark).read.schema(BARS).parquet(path))


def load_bars(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str] | None = None,
    start: Bound | None = None,
    end: Bound | None = None,
    end_day_inclusive: bool = False,
) -> DataFrame:
    """Load some or all symbols; unknown ones are simply absent. Symbol filters prune
    partitions and time bounds reach the parquet scan."""
    bars = read_library(spark, path)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    return slice_time(bars, start, end, end_day_inclusive)


def list_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def has_symbol(bars: DataFrame, symbol: str) -> bool:
    return not bars.where(F.col("symbol") == symbol).isEmpty()


def symbol_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def read_vendor_json(spark: SparkSession, path: str, landed: Sequence[str] | None = None) -> DataFrame:
    """Vendor aggregate records landed as JSON lines, by their short or long names.

    Columns are those that the files hold (``landed``; found by one scan if not given), so that
    a column no file has is told from one whose values are null.
    """
    use_utc(spark)
    names = set(spark.read.json(path).columns if landed is None else landed)
    optional = {*VENDOR_NAMES, *VENDOR_NAMES.values()}
    schema = T.StructType([f for f in VENDOR_BARS.fields if f.name in names or f.name not in optional])
    return nan_to_null(spark.read.schema(schema).json(path), [c for c in schema.names if c in optional])


def read_broker_bars(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Broker bars landed as CSV with local wall-clock dates in ``zone``; time becomes UTC."""
    raw = use_utc(spark).read.schema(BROKER_BARS).option("header", True).csv(path)
    local = F.to_timestamp("date", "yyyy-MM-dd HH:mm:ss")
    return nan_to_null(raw).withColumn("ts", F.to_utc_timestamp(local, zone)).drop("date")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICKER_CATALOG).json(path)


def active_tickers(catalog: DataFrame, market: str = "fx") -> DataFrame:
    return catalog.where((F.col("market") == market) & F.col("active")).select("ticker")


def read_monitor(spark: SparkSession, path: str) -> DataFrame:
    return use_utc(spark).read.schema(MONITOR).option("header", True).csv(path)


def latest_row(df: DataFrame, ts: str) -> DataFrame:
    """The last row by ``ts`` as a one-row frame, by a partial aggregate and no sort."""
    return df.agg(F.max_by(F.struct(*df.columns), F.col(ts)).alias("_row")).select("_row.*")


def save_bars(df: DataFrame, path: str, seconds: int = 365 * DAY) -> None:
    """Overwrite the symbols present in ``df``; other symbols stay, so empty input changes
    nothing (and is not looked for, which would compute ``df`` twice).

    Rows are spread by (symbol, year) so a hot symbol becomes several files, each sorted by time.
    """
    columns = set(df.columns)
    if "ts" not in columns:
        df = df.withColumnRenamed("date" if "date" in columns else "timestamp", "ts")
    (
        df.withColumn("_part", chunk_of("ts", seconds))
        .repartition("symbol", "_part")
        .sortWithinPartitions("symbol", "ts")
        .drop("_part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header and no index. One file only for a report whose size is bounded."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def drop_library(spark: SparkSession, table: str) -> bool:
    """Drop a library table if it is there; tells whether it was."""
    found = spark.catalog.tableExists(table)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return found
