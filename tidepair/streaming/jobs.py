"""Structured Streaming jobs. Late ticks are dropped behind an event-time watermark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepair.operators.ordered import order_key
from tidepair.operators.pairs import PAIR
from tidepair.operators.signals import STRATEGY_SIGNALS, allowed
from tidepair.session import scratch_path, use_utc
from tidepair.streaming.processors import (
    RATIO,
    REVERSION,
    SIGNAL,
    SNAPSHOT,
    KalmanPairStrategy,
    KeyedStep,
    MeanReversionStrategy,
    OrderGate,
    PriceBoard,
    RatioStrategy,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(
    spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """Files that land in a folder, at most ``max_files`` per micro-batch."""
    reader = use_utc(spark).readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def latest_prices(ticks: DataFrame, order: Sequence[str] = ("ts",), keep: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Latest valid price per instrument and ``keep`` period of event time.

    Partial aggregates keep a hot instrument cheap. A period's state goes once the watermark has
    passed its end, so instruments that trade no more hold no state; a reader takes the row with
    the greatest ``ts`` of each instrument.
    """
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", keep).alias("_w"), "key")
        .agg(F.max_by("price", order_key(order)).alias("price"), F.max("ts").alias("ts"))
        .drop("_w")
    )


def resample(
    ticks: DataFrame, width: str, delay: str, order: Sequence[str] = ("ts",), price: str = "price"
) -> DataFrame:
    """Tumbling bars, emitted once when the watermark passes their end."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("_w"), "symbol")
        .agg(F.max_by(price, order_key(order)).alias("close"))
        .select("symbol", F.col("_w.start").alias("ts"), "close")
    )


def pair_updates(
    ticks: DataFrame, pairs: DataFrame, width: str, delay: str, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Per pair and bucket the last price of each leg that traded in it.

    Two stateful operators in a chain: ticks are merged by bucket and symbol (on the map side
    first), and only the closed buckets' bars are handed to the pairs of their symbol and merged
    there. So ticks are shuffled once, whatever the number of pairs, and the step behind sees
    one row per pair and bucket. The bars keep the event time, so the second merge closes a bucket
    in the batch that closes its bars.
    """
    legs = pairs.select(*PAIR, F.col("leg_1").alias("symbol"), F.lit(1).alias("leg")).unionByName(
        pairs.select(*PAIR, F.col("leg_2").alias("symbol"), F.lit(2).alias("leg"))
    )
    bars = (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("_b"), "symbol")
        .agg(F.max_by("price", order_key(order)).alias("price"))
        .select("symbol", F.window_time("_b").alias("ts"), "price")
    )
    price = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("price")))
    return (
        bars.join(legs, "symbol")
        .groupBy(F.window("ts", width).alias("_w"), *PAIR)
        .agg(price(1).alias("y"), price(2).alias("x"))
        .select(*PAIR, F.col("_w.start").alias("ts"), "y", "x")
    )


def keyed(stream: DataFrame, processor: KeyedStep, schema: str, keys: Sequence[str] = PAIR) -> DataFrame:
    """Run a step per key with its state in the state store.

    A step that forgets its keys does so by event-time timers and needs a stream with a watermark.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "EventTime" if processor.forgets() else "None"
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode
    )


def ready_snapshots(updates: DataFrame) -> DataFrame:
    return keyed(updates, PriceBoard(), SNAPSHOT)


def idle_for(processor: KeyedStep, seconds: float | None) -> KeyedStep:
    """``processor``, forgetting a key that gets no rows for so many seconds of event time (more than
    a bucket and the watermark's delay, or keys are forgotten between buckets)."""
    processor.idle_s = seconds
    return processor


def signals(updates: DataFrame, idle_s: float | None = None, **params) -> DataFrame:
    """Strategy signals; ``idle_s`` forgets pairs that have stopped trading (needs a watermark)."""
    return keyed(updates, idle_for(KalmanPairStrategy(**params), idle_s), SIGNAL)


def mean_reversion(updates: DataFrame, hedge_ratio: float, **params) -> DataFrame:
    return keyed(updates, MeanReversionStrategy(hedge_ratio, **params), REVERSION)


def ratio(updates: DataFrame, **params) -> DataFrame:
    return keyed(updates, RatioStrategy(**params), RATIO)


def order_gate(
    stream: DataFrame, schema: str = SIGNAL, allow: Sequence[str] = STRATEGY_SIGNALS, delay: str = "10 minutes", **limits
) -> DataFrame:
    """Allow-listed signals that pass the per-pair cooldown and the optional limits.

    A timer closes the cooldown: once the watermark (``delay`` behind the latest signal) has passed
    its end, the pair holds no state until its next signal.
    """
    columns = [part.split()[0] for part in schema.split(", ")]
    return keyed(allowed(stream.withWatermark("ts", delay), allow), OrderGate(columns, **limits), schema)


def monitor_rows(df: DataFrame, ts: str = "ts", a: str = "y", b: str = "x", spread: str | None = None, z: str | None = None):
    """Telemetry columns; what a source lacks or leaves null becomes 0."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c else F.lit(0.0)
    return df.select(
        F.col(ts).alias("Timestamp"),
        value(a).alias("ASSET_A"),
        value(b).alias("ASSET_B"),
        value(spread).alias("Spread"),
        value(z).alias("Z-Score"),
    )


def csv_sink(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Batch writer for ``foreachBatch``: one folder per batch, so that a retried batch replaces
    itself; each file starts with the header."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch_id}")

    return write


def table_sink(path: str):
    """Like ``csv_sink`` in parquet, for update-mode queries."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Drain the available input into a parquet table (exactly once) and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, name: str, sink: Callable[[str], Callable], mode: str = "append") -> str:
    """Drain the available input through a ``foreachBatch`` sink; returns the table's path."""
    path = scratch_path(stream.sparkSession, name)
    (
        stream.writeStream.foreachBatch(sink(f"{path}/data"))
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return f"{path}/data"
