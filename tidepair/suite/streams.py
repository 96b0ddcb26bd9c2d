"""Streaming queries: the driver's events as a file stream, drained and compared as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepair.operators.clean import valid_ticks
from tidepair.operators.pairs import PAIR
from tidepair.plans.research import board_backtest
from tidepair.plans.strategies import run_strategy
from tidepair.sources.bars import read_monitor
from tidepair.sources.schemas import EVENTS_DDL
from tidepair.streaming import jobs
from tidepair.streaming.processors import POSITIONED, REVERSION, SIGNAL, MeanReversionStrategy, PositionedReversion
from tidepair.suite import data, sql
from tidepair.suite.joins import FFILL_SQL
from tidepair.suite.registry import query, rounded
from tidepair.suite.scans import INSTRUMENTS_SQL, RAW_TICKS_SQL, instruments, raw_ticks
from tidepair.suite.sql import over_bars, over_pairs, r
from tidepair.suite.trading import MR_SQL

# No two events share a timestamp.
ORDER = ("ts",)
WIDTH, DELAY = "60 minutes", "10 minutes"


def _events(spark, sf_dir):
    stream = jobs.file_stream(spark, sf_dir, EVENTS_DDL, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _ticks(spark, sf_dir):
    """Live ticks: symbol is the event type, price the event's value."""
    return _events(spark, sf_dir).select(
        "event_id", "ts", F.col("event_type").alias("symbol"), (F.col("value") + 100).alias("price")
    )


def _pair_updates(spark, sf_dir):
    chosen = data.stats(spark, sf_dir).select(*PAIR)
    return jobs.pair_updates(_ticks(spark, sf_dir), chosen, WIDTH, DELAY, ORDER)


# Bars that the watermark has closed by the end of the input, and the price board over them.
_CLOSED = f"""closed AS MATERIALIZED (SELECT symbol, b AS ts, arg_max(value + 100, (ts, event_id)) AS close
  FROM (SELECT event_type AS symbol, {sql.bucket(60)} AS b, ts, event_id, value FROM events) GROUP BY symbol, b
  HAVING b + INTERVAL 60 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES)"""
_BOARD = """legs AS (SELECT a.symbol AS leg_1, b.symbol AS leg_2 FROM (SELECT DISTINCT symbol FROM closed) a, (SELECT DISTINCT symbol FROM closed) b WHERE a.symbol < b.symbol),
updates AS (SELECT leg_1, leg_2, ts, max(CASE WHEN symbol = leg_1 THEN close END) AS y, max(CASE WHEN symbol = leg_2 THEN close END) AS x
  FROM legs JOIN closed ON symbol = leg_1 OR symbol = leg_2 GROUP BY ALL),
board AS (SELECT leg_1, leg_2, ts, last_value(y IGNORE NULLS) OVER w AS y, last_value(x IGNORE NULLS) OVER w AS x FROM updates
  WINDOW w AS (PARTITION BY leg_1, leg_2 ORDER BY ts)),
pairs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY leg_1, leg_2 ORDER BY ts) AS pos FROM board WHERE y IS NOT NULL AND x IS NOT NULL)"""
_VALID = "price IS NOT NULL AND NOT isnan(price) AND price > 0"


@query(
    "tick_stream",
    sql.query(
        INSTRUMENTS_SQL,
        RAW_TICKS_SQL,
        body=f"SELECT con_id, event_id, ts, price, key FROM raw_ticks JOIN instruments USING (con_id) WHERE {_VALID}",
    ),
)
def tick_stream(spark, sf_dir):
    ticks = valid_ticks(raw_ticks(_events(spark, sf_dir)), instruments(spark, sf_dir))
    return jobs.run_append(ticks, "ticks")


@query(
    "stream_latest_price",
    sql.query(
        INSTRUMENTS_SQL,
        RAW_TICKS_SQL,
        body=f"SELECT key, arg_max(price, (ts, event_id)) AS price, max(ts) AS ts FROM raw_ticks JOIN instruments USING (con_id) WHERE {_VALID} GROUP BY key",
    ),
)
def stream_latest_price(spark, sf_dir):
    ticks = valid_ticks(raw_ticks(_events(spark, sf_dir)), instruments(spark, sf_dir))
    path = jobs.run_batches(jobs.latest_prices(ticks, ORDER), "latest", jobs.table_sink, "update")
    written = spark.read.schema("key string, price double, ts timestamp, batch long").parquet(path)
    return written.groupBy("key").agg(F.max_by("price", F.struct("ts", "batch")).alias("price"), F.max("ts").alias("ts"))


@query("stream_resample", sql.query(_CLOSED, body="SELECT symbol, ts, close FROM closed"))
def stream_resample(spark, sf_dir):
    return jobs.run_append(jobs.resample(_ticks(spark, sf_dir), WIDTH, DELAY, ORDER), "bars")


@query("stream_ready_snapshot", sql.query(_CLOSED, _BOARD, body="SELECT leg_1, leg_2, ts, y, x FROM pairs"))
def stream_ready_snapshot(spark, sf_dir):
    return jobs.run_append(jobs.ready_snapshots(_pair_updates(spark, sf_dir)), "snapshots")


_SIGNALS = [
    _CLOSED,
    _BOARD,
    sql.kalman([1e-4]),
    sql.positions("kf", "z_score", [(2.0, 0.5)], "abs", False),
    """sig AS MATERIALIZED (SELECT w.leg_1, w.leg_2, w.ts, CASE WHEN w.leaves THEN 'EXIT_ALL' WHEN w.side > 0 THEN 'ENTRY_LONG_SPREAD'
      ELSE 'ENTRY_SHORT_SPREAD' END AS signal_type, CASE WHEN w.leaves THEN w.side_before ELSE w.side END AS side, k.y, k.x,
      k.z_score, k.beta, k.y - k.error AS predicted_y, k.error
    FROM walk w JOIN kf k USING (leg_1, leg_2, ts) WHERE w.leaves OR w.enters)""",
]
_SIGNAL_COLUMNS = f"""leg_1, leg_2, ts, signal_type, CAST(side AS INTEGER) AS side, y, x, {r('z_score', 5)} AS z_score, {r('beta')} AS beta,
  {r('predicted_y', 4)} AS predicted_y, {r('error', 4)} AS error"""


def _report(df):
    return rounded(rounded(rounded(df, "z_score", digits=5), "beta"), "predicted_y", "error", digits=4)


@query("stream_signals", sql.query(*_SIGNALS, body=f"SELECT {_SIGNAL_COLUMNS} FROM sig", recursive=True))
def stream_signals(spark, sf_dir):
    return _report(jobs.run_append(jobs.signals(_pair_updates(spark, sf_dir)), "signals"))


_RATIO = 1.05


@query(
    "stream_mean_reversion",
    sql.query(_CLOSED, _BOARD, MR_SQL, body=f"SELECT leg_1, leg_2, ts, signal_type, {r('z', 5)} AS z_score, {r('spread', 4)} AS spread FROM mr"),
)
def stream_mean_reversion(spark, sf_dir):
    found = jobs.run_append(jobs.mean_reversion(_pair_updates(spark, sf_dir), 1.25), "reversion")
    return rounded(rounded(found.drop("y", "x"), "z_score", digits=5), "spread", digits=4)


@query(
    "stream_ratio",
    sql.query(_CLOSED, _BOARD, body=f"SELECT leg_1, leg_2, ts, 'DEMO_ENTRY' AS signal_type, {r('y / x')} AS ratio FROM pairs WHERE y / x > {_RATIO}"),
)
def stream_ratio(spark, sf_dir):
    found = jobs.run_append(jobs.ratio(_pair_updates(spark, sf_dir), threshold=_RATIO), "ratio")
    return rounded(found.drop("y", "x"), "ratio")


@query(
    "strategy_batch",
    over_pairs(f"SELECT leg_1, leg_2, ts, signal_type, {r('z', 5)} AS z_score, {r('spread', 4)} AS spread FROM mr", 60, MR_SQL),
)
def strategy_batch(spark, sf_dir):
    """The streamed mean-reversion step as a plug-in of the batch path, over blocks of 256 rows."""
    rows = data.pairs(spark, sf_dir).select(*PAIR, "ts", "y", "x")
    found = run_strategy(rows, MeanReversionStrategy(1.25), REVERSION, block_rows=256, seconds=data.CHUNK_SECONDS).drop("y", "x")
    return rounded(rounded(found, "z_score", digits=5), "spread", digits=4)


POSITIONED_SQL = [
    """scored AS MATERIALIZED (SELECT leg_1, leg_2, 0.0::DOUBLE AS delta, ts, pos, y, x, spread, CASE WHEN n >= 20 THEN (spread - m) / nullif(s, 0) END AS z
  FROM (SELECT *, count(*) OVER w AS n, avg(spread) OVER w AS m, stddev_pop(spread) OVER w AS s FROM (SELECT *, y - 1.25::DOUBLE * x AS spread FROM pairs)
    WINDOW w AS (PARTITION BY leg_1, leg_2 ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))""",
    sql.positions("scored", "z", [(2.0, 0.5)], "abs", False),
    """held AS MATERIALIZED (SELECT leg_1, leg_2, w.ts, CASE WHEN w.leaves THEN 'EXIT_ALL' WHEN w.side > 0 THEN 'ENTRY_LONG' ELSE 'ENTRY_SHORT' END AS signal_type,
    CAST(CASE WHEN w.leaves THEN w.side_before ELSE w.side END AS INTEGER) AS side, w.z, w.spread FROM walk w WHERE w.leaves OR w.enters)""",
]


@query(
    "strategy_positions",
    over_pairs(
        f"SELECT leg_1, leg_2, ts, signal_type, side, {r('z', 5)} AS z_score, {r('spread', 4)} AS spread FROM held", 60, *POSITIONED_SQL, recursive=True
    ),
)
def strategy_positions(spark, sf_dir):
    """A strategy that holds positions, over blocks of 256 rows: each block is walked from flat, long and short."""
    rows = data.pairs(spark, sf_dir).select(*PAIR, "ts", "y", "x")
    found = run_strategy(rows, PositionedReversion(1.25), POSITIONED, block_rows=256, seconds=data.CHUNK_SECONDS).drop("y", "x")
    return rounded(rounded(found, "z_score", digits=5), "spread", digits=4)


_BOARD_PAIRS = """pairs AS MATERIALIZED (SELECT a.symbol AS leg_1, b.symbol AS leg_2, a.ts, a.close AS y, b.close AS x,
    row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) AS pos
  FROM filled a JOIN filled b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ts >= (SELECT t FROM ready))"""
_BOARD_ORDERS = """orders_ AS (SELECT ts, signal_type, leg_1 AS asset, buys AS buys, 10.0::DOUBLE AS qty FROM turned
  UNION ALL SELECT ts, signal_type, leg_2, NOT buys, 12.0::DOUBLE FROM turned)"""


@query(
    "board_ledger",
    over_bars(
        """SELECT o.ts AS "time", o.signal_type AS signal, o.asset, CASE WHEN o.buys THEN 'BUY' ELSE 'SELL' END AS action, o.qty, f.close AS price
        FROM orders_ o JOIN filled f ON f.symbol = o.asset AND f.ts = o.ts""",
        15,
        FFILL_SQL,
        _BOARD_PAIRS,
        *POSITIONED_SQL,
        "turned AS (SELECT *, signal_type = 'ENTRY_LONG' OR (signal_type = 'EXIT_ALL' AND side < 0) AS buys FROM held)",
        _BOARD_ORDERS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def board_ledger(spark, sf_dir):
    """Backtest over the filled board of all instruments, with the ledger of its orders."""
    chosen = data.stats(spark, sf_dir, 15).select(*PAIR)
    closes = data.closes(spark, sf_dir, 15)
    return board_backtest(closes, chosen, PositionedReversion(1.25), POSITIONED, 10, 12, data.CHUNK_SECONDS)


def _signal_table(spark, sf_dir):
    """Path of the signals table that the strategy job leaves, for the jobs behind it."""
    return jobs.run_batches(jobs.signals(_pair_updates(spark, sf_dir)), "signals", jobs.table_sink)


@query(
    "stream_telemetry",
    sql.query(
        *_SIGNALS,
        body=f"""SELECT ts AS "Timestamp", y AS "ASSET_A", x AS "ASSET_B", {r('y - beta * x', 4)} AS "Spread", {r('z_score', 5)} AS "Z-Score" FROM sig""",
        recursive=True,
    ),
)
def stream_telemetry(spark, sf_dir):
    found = jobs.signals(_pair_updates(spark, sf_dir))
    spread = F.col("y") - F.col("beta") * F.col("x")
    shape = lambda df: jobs.monitor_rows(df.withColumn("spread", spread), spread="spread", z="z_score")
    path = jobs.run_batches(found, "telemetry", lambda p: jobs.csv_sink(p, shape))
    log = read_monitor(spark, f"{path}/batch=*")
    return rounded(log, "Spread", digits=4).withColumn("Z-Score", F.round("`Z-Score`", 5))


@query(
    "monitor_append",
    sql.query(
        _CLOSED,
        _BOARD,
        body="""SELECT ts AS "Timestamp", coalesce(y, 0.0) AS "ASSET_A", coalesce(x, 0.0) AS "ASSET_B", 0.0::DOUBLE AS "Spread", 0.0::DOUBLE AS "Z-Score" FROM updates""",
    ),
)
def monitor_append(spark, sf_dir):
    path = jobs.run_batches(_pair_updates(spark, sf_dir), "monitor", lambda p: jobs.csv_sink(p, jobs.monitor_rows))
    return read_monitor(spark, f"{path}/batch=*")


_COOLDOWN_S = 8 * 3600
_GATE = f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY leg_1, leg_2 ORDER BY ts) AS k FROM sig
    WHERE signal_type IN ('ENTRY_LONG_SPREAD', 'ENTRY_SHORT_SPREAD', 'EXIT_ALL')),
gate AS (SELECT leg_1, leg_2, k, ts AS last, true AS sent FROM ranked WHERE k = 1
  UNION ALL SELECT n.leg_1, n.leg_2, n.k, CASE WHEN n.ts >= g.last + INTERVAL {_COOLDOWN_S} SECONDS THEN n.ts ELSE g.last END,
    n.ts >= g.last + INTERVAL {_COOLDOWN_S} SECONDS FROM gate g JOIN ranked n ON n.leg_1 = g.leg_1 AND n.leg_2 = g.leg_2 AND n.k = g.k + 1)"""


@query(
    "stream_order_gate",
    sql.query(
        *_SIGNALS,
        _GATE,
        body="SELECT leg_1, leg_2, ts, signal_type FROM gate JOIN ranked USING (leg_1, leg_2, k) WHERE sent",
        recursive=True,
    ),
)
def stream_order_gate(spark, sf_dir):
    table = _signal_table(spark, sf_dir)
    stream = jobs.file_stream(spark, f"{table}/batch=*", SIGNAL)
    passed = jobs.run_append(jobs.order_gate(stream, cooldown_s=_COOLDOWN_S), "gate")
    return passed.select(*PAIR, "ts", "signal_type")
