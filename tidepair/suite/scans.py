"""Sources, sinks, projections, filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepair.operators import clean, pnl, signals
from tidepair.operators.pairs import PAIR
from tidepair.operators.windows import top_k
from tidepair.session import scratch_path
from tidepair.sources import bars as store
from tidepair.suite import data, sql
from tidepair.suite.registry import query, rounded
from tidepair.suite.sql import over_bars, over_pairs, r

OHLCV = "symbol, ts, open, high, low, close, volume"

# Currencies of the derived ticker catalogue, liquid and not.
CATALOG_CURRENCIES = ["USD", "EUR", "JPY", "AED", "GBP", "AUD", "CAD", "BHD", "CHF", "NZD", "TRY", "ZAR", "SEK"]
CATALOG_SQL = f"""catalog AS (
  SELECT (CASE WHEN c_nationkey = 7 THEN 'X:' ELSE 'C:' END)
      || ({CATALOG_CURRENCIES})[1 + c_custkey % 13] || ({CATALOG_CURRENCIES})[1 + c_nationkey % 13]
      || (CASE WHEN c_nationkey = 11 THEN 'X' ELSE '' END) AS ticker,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'stocks' ELSE 'fx' END AS market,
    c_acctbal > 0 AS active
  FROM customer)"""


def catalog(spark, sf_dir):
    """A ticker catalogue landed as JSON, one ticker per customer."""
    customers = data.table(spark, sf_dir, "customer")
    currency = lambda c: F.element_at(
        F.array(*map(F.lit, CATALOG_CURRENCIES)), (1 + F.col(c) % 13).cast("int")
    )
    rows = customers.select(
        F.concat(
            F.when(F.col("c_nationkey") == 7, "X:").otherwise("C:"),
            currency("c_custkey"),
            currency("c_nationkey"),
            F.when(F.col("c_nationkey") == 11, "X").otherwise(""),
        ).alias("ticker"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "stocks").otherwise("fx").alias("market"),
        (F.col("c_acctbal") > 0).alias("active"),
    )
    path = scratch_path(spark, "catalog")
    rows.write.json(path)
    return store.read_catalog(spark, path)


def landed_ticks(spark, sf_dir):
    """Ticks as vendor records: minute stamps, so copies of a minute occur, and no vwap."""
    ticks = data.ticks(spark, sf_dir)
    minute = F.date_trunc("minute", "ts")
    return ticks.select(
        F.col("symbol").alias("ticker"),
        F.unix_millis(minute).alias("timestamp"),
        F.col("price").alias("o"),
        F.col("price").alias("h"),
        F.col("price").alias("l"),
        F.col("price").alias("c"),
        F.lit(1.0).alias("v"),
        F.col("event_id").alias("ingest_seq"),
    )


def vendor_bars(raw):
    """Landed vendor records as bars, arrival number kept."""
    timed = raw.withColumn("ts", clean.epoch_ms("timestamp")).withColumnRenamed("ticker", "symbol")
    return clean.normalize_bars(timed, keep=("symbol", "ts", "ingest_seq"))


# ---- sources ---------------------------------------------------------------------------------


@query(
    "scan_bars",
    over_bars(
        f"SELECT {OHLCV} FROM bars WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' "
        "AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
    ),
)
def scan_bars(spark, sf_dir):
    path = data.bars_path(spark, sf_dir, 60)
    return store.load_bars(spark, path, ["click"], "2024-01-05", "2024-01-20 12:00:00").select(*OHLCV.split(", "))


@query(
    "scan_universe",
    over_bars(f"SELECT {OHLCV}, {r('vwap')} AS vwap FROM bars WHERE symbol IN ('click', 'view', 'purchase', 'error', 'signup', 'absent')"),
)
def scan_universe(spark, sf_dir):
    wanted = ["click", "view", "purchase", "error", "signup", "absent"]
    return rounded(store.load_bars(spark, data.bars_path(spark, sf_dir, 60), wanted), "vwap")


@query("list_symbols", over_bars("SELECT DISTINCT symbol FROM bars"))
def list_symbols(spark, sf_dir):
    return store.list_symbols(data.bars(spark, sf_dir))


@query(
    "symbol_summary",
    over_bars("SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM bars GROUP BY symbol", 15),
)
def symbol_summary(spark, sf_dir):
    return store.symbol_summary(data.bars(spark, sf_dir, 15))


_VENDOR_SQL = """SELECT symbol, date_trunc('minute', ts) AS ts, arg_max(price, event_id) AS open,
  arg_max(price, event_id) AS high, arg_max(price, event_id) AS low, arg_max(price, event_id) AS close,
  1.0::DOUBLE AS volume, arg_max(price + 0.05, event_id) AS vwap FROM ticks GROUP BY symbol, date_trunc('minute', ts)"""


@query("vendor_bars_json", sql.query(sql.TICKS, body=_VENDOR_SQL))
def vendor_bars_json(spark, sf_dir):
    path = scratch_path(spark, "vendor")
    landed_ticks(spark, sf_dir).withColumn("vw", F.col("c") + 0.05).write.json(path)
    fresh = vendor_bars(store.read_vendor_json(spark, path))
    return clean.dedupe(fresh, ["symbol", "ts"], "ingest_seq", "last").drop("ingest_seq")


@query("broker_bars", over_bars(f"SELECT {OHLCV} FROM bars"))
def broker_bars(spark, sf_dir):
    zone = "America/New_York"
    local = F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd HH:mm:ss").alias("date")
    path = scratch_path(spark, "broker")
    bars = data.bars(spark, sf_dir).select("symbol", local, "open", "high", "low", "close", "volume")
    bars.write.option("header", True).csv(path)
    return store.read_broker_bars(spark, path, zone).select(*OHLCV.split(", "))


@query("ticker_catalog", sql.query(CATALOG_SQL, body="SELECT ticker FROM catalog WHERE market = 'fx' AND active"))
def ticker_catalog(spark, sf_dir):
    return store.active_tickers(catalog(spark, sf_dir))


CHAMPION_SQL = """champion AS (SELECT leg_1, leg_2 FROM stats ORDER BY round(corr, 9) DESC, leg_1, leg_2 LIMIT 1)"""
MONITOR_SQL = f"""monitor AS (SELECT ts AS "Timestamp", y AS "ASSET_A", x AS "ASSET_B", {r('spread')} AS "Spread",
  {r('coalesce(rolling_z, 0.0)')} AS "Z-Score" FROM scored JOIN champion USING (leg_1, leg_2))"""
MONITOR_CTES = [sql.STATS, sql.RESIDUALS, sql.rolling("resid", "leg_1, leg_2"), CHAMPION_SQL, MONITOR_SQL]


def pair_telemetry(rows):
    """Prices, residual spread and rolling z of pair rows."""
    spread = rows.withColumn("spread", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    scored = data.rolling_z(spread, PAIR).withColumn("z", F.coalesce("rolling_z", F.lit(0.0)))
    return rounded(scored, "spread", "z").select(
        *PAIR,
        F.col("ts").alias("Timestamp"),
        F.col("y").alias("ASSET_A"),
        F.col("x").alias("ASSET_B"),
        F.col("spread").alias("Spread"),
        F.col("z").alias("Z-Score"),
    )


def monitor_rows(spark, sf_dir):
    """Telemetry of the pair with the highest correlation."""
    best = top_k(data.stats(spark, sf_dir), 1, [F.desc(F.round("corr", 9)), "leg_1", "leg_2"]).select(*PAIR)
    return pair_telemetry(data.pairs(spark, sf_dir).join(best, PAIR, "left_semi")).drop(*PAIR)


def monitor_log(spark, sf_dir):
    path = scratch_path(spark, "monitor")
    store.write_csv(monitor_rows(spark, sf_dir), path)
    return store.read_monitor(spark, path)


@query(
    "read_monitor",
    over_pairs('SELECT * FROM monitor ORDER BY "Timestamp" DESC LIMIT 1', 60, *MONITOR_CTES),
)
def read_monitor(spark, sf_dir):
    return store.latest_row(monitor_log(spark, sf_dir), "Timestamp")


@query(
    "recent_log",
    over_pairs('SELECT * FROM monitor ORDER BY "Timestamp" DESC LIMIT 10', 60, *MONITOR_CTES),
)
def recent_log(spark, sf_dir):
    return top_k(monitor_log(spark, sf_dir), 10, [F.desc("Timestamp")])


@query(
    "z_zone",
    over_pairs(
        f"""SELECT *, CASE WHEN "Z-Score" > 2 THEN 'inverse' WHEN "Z-Score" < -2 THEN 'off' ELSE 'normal' END AS zone
           FROM (SELECT leg_1, leg_2, ts AS "Timestamp", {r('coalesce(rolling_z, 0.0)')} AS "Z-Score" FROM scored)""",
        60,
        *MONITOR_CTES[:3],
    ),
)
def z_zone(spark, sf_dir):
    """The zone of every pair at every time."""
    log = pair_telemetry(data.pairs(spark, sf_dir))
    return log.select(*PAIR, "Timestamp", "`Z-Score`", signals.z_zone(F.col("`Z-Score`")).alias("zone"))


# ---- sinks -----------------------------------------------------------------------------------


@query(
    "save_bars",
    sql.query(
        sql.TICKS,
        sql.bars(60).replace("bars AS", "hourly AS"),
        sql.bars(15).replace("bars AS", "quarter AS"),
        body=f"SELECT {OHLCV} FROM hourly WHERE symbol <> 'click' UNION ALL SELECT {OHLCV} FROM quarter WHERE symbol = 'click'",
    ),
)
def save_bars(spark, sf_dir):
    path = scratch_path(spark, "library")
    store.save_bars(data.bars(spark, sf_dir, 60), path)
    finer = data.bars(spark, sf_dir, 15).where(F.col("symbol") == "click")
    store.save_bars(finer.withColumnRenamed("ts", "timestamp"), path)
    store.save_bars(finer.where(F.lit(False)), path)  # empty input changes nothing
    return store.read_library(spark, path).select(*OHLCV.split(", "))


_PATCH_SQL = """patch AS (SELECT symbol, ts, open, high, low, close + 1 AS close, volume, vwap FROM bars
  WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-12' AND volume >= 2),
bounds AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM patch GROUP BY symbol)"""
_UPSERT_SQL = f"""SELECT {OHLCV} FROM bars LEFT JOIN bounds USING (symbol)
  WHERE lo IS NULL OR ts < lo OR ts > hi UNION ALL SELECT {OHLCV} FROM patch"""


def _patch(bars):
    """A repair file that covers four days but lacks the thin bars."""
    window = store.slice_time(bars, "2024-01-08", "2024-01-11", end_day_inclusive=True)
    return window.where(F.col("volume") >= 2).withColumn("close", F.col("close") + 1)


@query("range_upsert", over_bars(_UPSERT_SQL, 60, _PATCH_SQL))
def range_upsert(spark, sf_dir):
    bars = data.bars(spark, sf_dir)
    return clean.range_upsert(bars, _patch(bars)).select(*OHLCV.split(", "))


@query(
    "patch_union",
    over_bars(
        """SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(close), 2) AS close_sum
           FROM (""" + _UPSERT_SQL + ") GROUP BY ALL",
        60,
        _PATCH_SQL,
    ),
)
def patch_union(spark, sf_dir):
    bars = data.bars(spark, sf_dir)
    patch = _patch(bars)
    once = clean.range_upsert(bars, patch)
    again = clean.range_upsert(once, patch)  # a second run must change nothing
    return again.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("close_sum")
    )


@query(
    "drop_library",
    over_bars(
        "SELECT symbol, count(*) AS n_rows, true AS dropped, false AS still_there FROM bars GROUP BY symbol"
    ),
)
def drop_library(spark, sf_dir):
    path = scratch_path(spark, "dropped")
    store.save_bars(data.bars(spark, sf_dir), path)
    name = f"library_{path[-8:]}"
    spark.catalog.createTable(name, path=path, source="parquet", schema=store.BARS)
    dropped = store.drop_library(spark, name)
    still = spark.catalog.tableExists(name)
    counts = store.read_library(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("symbol", "n_rows", F.lit(dropped).alias("dropped"), F.lit(still).alias("still_there"))


@query(
    "export_csv",
    over_pairs(
        """SELECT leg_1 AS "Leg_1", leg_2 AS "Leg_2", round(corr, 3) AS "Correlation", round(beta, 3) AS "Hedge_Ratio"
           FROM stats WHERE round(corr, 3) >= 0.8""",
        60,
        sql.STATS,
    ),
)
def export_csv(spark, sf_dir):
    ranked = data.stats(spark, sf_dir).select(
        F.col("leg_1").alias("Leg_1"),
        F.col("leg_2").alias("Leg_2"),
        F.round("corr", 3).alias("Correlation"),
        F.round("beta", 3).alias("Hedge_Ratio"),
    )
    path = scratch_path(spark, "candidates")
    store.write_csv(ranked.where(F.col("Correlation") >= 0.8), path)
    return spark.read.schema(ranked.schema).option("header", True).csv(path)


# ---- projections, filters, de-duplication ----------------------------------------------------


@query(
    "normalize_columns",
    sql.query(
        sql.TICKS,
        body="""SELECT symbol, date_trunc('minute', ts) AS ts, event_id AS ingest_seq, price AS open, price AS high,
          price AS low, price AS close, 1.0::DOUBLE AS volume, 0.0::DOUBLE AS vwap FROM ticks""",
    ),
)
def normalize_columns(spark, sf_dir):
    return vendor_bars(landed_ticks(spark, sf_dir))


@query("epoch_ms_to_ts", "SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def epoch_ms_to_ts(spark, sf_dir):
    millis = data.events(spark, sf_dir).select("event_id", F.unix_millis("ts").alias("ms"))
    return millis.select("event_id", clean.epoch_ms("ms").alias("ts"))


_DEDUPE_SQL = "SELECT symbol, date_trunc('minute', ts) AS ts, {f}(price, event_id) AS close, {f}(event_id, event_id) AS ingest_seq FROM ticks GROUP BY symbol, date_trunc('minute', ts)"


def _copies(spark, sf_dir):
    return vendor_bars(landed_ticks(spark, sf_dir)).select("symbol", "ts", "close", "ingest_seq")


@query("dedupe_keep_last", sql.query(sql.TICKS, body=_DEDUPE_SQL.format(f="arg_max")))
def dedupe_keep_last(spark, sf_dir):
    return clean.dedupe(_copies(spark, sf_dir), ["symbol", "ts"], "ingest_seq", "last")


@query("dedupe_keep_first", sql.query(sql.TICKS, body=_DEDUPE_SQL.format(f="arg_min")))
def dedupe_keep_first(spark, sf_dir):
    return clean.dedupe(_copies(spark, sf_dir), ["symbol", "ts"], "ingest_seq", "first")


# Asset type of a symbol in the derived universe.
_ASSET_SQL = "CASE WHEN symbol IN ('click', 'view') THEN 'STK' WHEN symbol = 'error' THEN 'FUT' ELSE 'CASH' END"


def _asset_type():
    return (
        F.when(F.col("symbol").isin("click", "view"), "STK").when(F.col("symbol") == "error", "FUT").otherwise("CASH")
    )


@query(
    "clip_backfill",
    over_bars(
        f"""SELECT symbol, {_ASSET_SQL} AS asset_type, count(*) AS persisted, min(ts) AS first_ts FROM bars
        WHERE {_ASSET_SQL} <> 'FUT' AND ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""",
        15,
    ),
)
def clip_backfill(spark, sf_dir):
    bars = data.bars(spark, sf_dir, 15).withColumn("asset_type", _asset_type())
    kept = clean.clip_backfill(bars, "2024-01-10")
    return kept.groupBy("symbol", "asset_type").agg(
        F.count(F.lit(1)).alias("persisted"), F.min("ts").alias("first_ts")
    )


@query("price_type_for_asset", over_bars(f"SELECT DISTINCT symbol, {_ASSET_SQL} AS asset_type, CASE WHEN {_ASSET_SQL} = 'CASH' THEN 'MIDPOINT' ELSE 'TRADES' END AS price_type FROM bars"))
def price_type_for_asset(spark, sf_dir):
    typed = store.list_symbols(data.bars(spark, sf_dir)).withColumn("asset_type", _asset_type())
    return typed.withColumn("price_type", clean.price_type("asset_type"))


# Instruments: customers with a positive balance; ticks carry the user's number as contract id.
INSTRUMENTS_SQL = """instruments AS (SELECT c_custkey AS con_id, 'C' || c_custkey AS key,
  c_mktsegment AS contract, c_custkey AS position FROM customer WHERE c_acctbal > 0)"""
RAW_TICKS_SQL = """raw_ticks AS (SELECT event_id, user_id AS con_id, ts,
  CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE WHEN event_type = 'signup' THEN NULL ELSE value - 1 END AS price FROM events)"""


def instruments(spark, sf_dir):
    customers = data.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return customers.select(
        F.col("c_custkey").alias("con_id"),
        F.concat(F.lit("C"), "c_custkey").alias("key"),
        F.col("c_mktsegment").alias("contract"),
        F.col("c_custkey").alias("position"),
    )


def raw_ticks(events):
    """Vendor ticks with the defects a live feed has: NaN, null and non-positive prices."""
    price = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "signup", F.lit(None).cast("double"))
        .otherwise(F.col("value") - 1)
    )
    return events.select("event_id", F.col("user_id").alias("con_id"), "ts", price.alias("price"))


@query(
    "filter_valid_price",
    sql.query(
        INSTRUMENTS_SQL,
        RAW_TICKS_SQL,
        body="SELECT con_id, event_id, ts, price, key FROM raw_ticks JOIN instruments USING (con_id) WHERE price IS NOT NULL AND NOT isnan(price) AND price > 0",
    ),
)
def filter_valid_price(spark, sf_dir):
    return clean.valid_ticks(raw_ticks(data.events(spark, sf_dir)), instruments(spark, sf_dir))


@query("require_legs", over_pairs("SELECT leg_1, leg_2, ts, y, x FROM pairs", 15))
def require_legs(spark, sf_dir):
    return data.pairs(spark, sf_dir, 15).select(*PAIR, "ts", "y", "x")


_LIQUID = ", ".join(f"'{c}'" for c in clean.LIQUID_CURRENCIES)


@query(
    "liquid_ticker_filter",
    sql.query(
        CATALOG_SQL,
        body=f"SELECT ticker, market, active FROM catalog WHERE length(ticker) = 8 AND starts_with(ticker, 'C:') AND substring(ticker, 3, 3) IN ({_LIQUID}) AND substring(ticker, 6, 3) IN ({_LIQUID})",
    ),
)
def liquid_ticker_filter(spark, sf_dir):
    return clean.liquid_tickers(catalog(spark, sf_dir))


@query(
    "slice_time",
    over_bars(
        """SELECT 'midnight' AS flavour, symbol, ts, close FROM bars WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'
        UNION ALL SELECT 'whole_day', symbol, ts, close FROM bars WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""",
    ),
)
def slice_time(spark, sf_dir):
    closes = data.closes(spark, sf_dir)
    midnight = store.slice_time(closes, "2024-01-10", "2024-01-12")
    whole = store.slice_time(closes, "2024-01-10", "2024-01-12", end_day_inclusive=True)
    return midnight.withColumn("flavour", F.lit("midnight")).unionByName(whole.withColumn("flavour", F.lit("whole_day")))


@query("select_close", over_bars("SELECT symbol, ts, close FROM bars", 15))
def select_close(spark, sf_dir):
    return data.closes(spark, sf_dir, 15)


@query(
    "spread",
    over_pairs(
        f"""SELECT leg_1, leg_2, ts, {r('y - 1.5::DOUBLE * x')} AS static_spread, {r('y - round(beta, 6) * x')} AS ols_spread,
        {r('y - round(alpha, 3) - round(beta, 6) * x')} AS residual FROM pairs JOIN stats USING (leg_1, leg_2)""",
        60,
        sql.STATS,
    ),
)
def spread(spark, sf_dir):
    # The line as published, rounded, so that every reader computes the same spread.
    y, x, beta, alpha = F.col("y"), F.col("x"), F.round("beta", 6), F.round("alpha", 3)
    rows = data.pairs(spark, sf_dir).select(
        *PAIR,
        "ts",
        (y - 1.5 * x).alias("static_spread"),
        (y - beta * x).alias("ols_spread"),
        (y - alpha - beta * x).alias("residual"),
    )
    return rounded(rows, "static_spread", "ols_spread", "residual")


@query("ratio", over_pairs(f"SELECT leg_1, leg_2, ts, {r('y / x')} AS ratio FROM pairs"))
def ratio(spark, sf_dir):
    rows = data.pairs(spark, sf_dir).select(*PAIR, "ts", F.try_divide("y", "x").alias("ratio"))
    return rounded(rows, "ratio")


_BAND = pnl.break_even(1.1)


@query(
    "cost_band",
    over_pairs(
        f"""SELECT leg_1, leg_2, ts, {r('d')} AS deviation, abs(d) <= {_BAND!r}::DOUBLE AS inside_cost FROM (
        SELECT *, y - 1.1::DOUBLE * x - avg(y - 1.1::DOUBLE * x) OVER (PARTITION BY leg_1, leg_2) AS d FROM pairs)"""
    ),
)
def cost_band(spark, sf_dir):
    rows = data.pairs(spark, sf_dir).select(*PAIR, "ts", "y", "x")
    return rounded(pnl.cost_band(rows, 1.1), "deviation").drop("y", "x")
