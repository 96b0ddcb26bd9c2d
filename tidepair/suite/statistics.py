"""Aggregates, pair statistics, window functions and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepair.operators import pairs, stats, windows
from tidepair.operators.ordered import with_position
from tidepair.operators.pairs import PAIR
from tidepair.plans import discovery
from tidepair.suite import data, sql
from tidepair.suite.joins import _PERF, _TOP_BOTTOM, customer_totals
from tidepair.suite.registry import query, rounded
from tidepair.suite.sql import over_bars, over_pairs, r

# ---- pair statistics -------------------------------------------------------------------------


@query("pair_corr", over_pairs(f"SELECT leg_1, leg_2, n, {r('corr')} AS corr FROM stats WHERE corr >= 0.8 AND n >= 30", 60, sql.STATS))
def pair_corr(spark, sf_dir):
    found = data.stats(spark, sf_dir).where((F.col("corr") >= 0.8) & (F.col("n") >= 30))
    return rounded(found.select(*PAIR, "n", "corr"), "corr")


_RETURNS = """rets AS MATERIALIZED (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret
  FROM (SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)))) WHERE ret IS NOT NULL)"""


@query(
    "corr_matrix",
    over_bars(
        f"SELECT a.symbol AS leg_1, b.symbol AS leg_2, {r('corr(a.ret, b.ret)')} AS corr FROM rets a JOIN rets b ON a.ts = b.ts GROUP BY ALL",
        60,
        _RETURNS,
    ),
)
def corr_matrix(spark, sf_dir):
    returns = discovery.universe_returns(data.closes(spark, sf_dir), seconds=data.CHUNK_SECONDS)
    return rounded(pairs.correlation_matrix(returns, "ret"), "corr")


@query(
    "ols_hedge",
    over_pairs(f"SELECT leg_1, leg_2, n, {r('beta')} AS beta, {r('alpha', 4)} AS alpha FROM stats", 15, sql.STATS),
)
def ols_hedge(spark, sf_dir):
    lines = data.stats(spark, sf_dir, 15).select(*PAIR, "n", "beta", "alpha")
    return rounded(rounded(lines, "beta"), "alpha", digits=4)


@query(
    "ols_no_intercept",
    over_pairs(f"SELECT leg_1, leg_2, {r('sum(x * y) / sum(x * x)')} AS beta FROM pairs GROUP BY leg_1, leg_2", 15),
)
def ols_no_intercept(spark, sf_dir):
    return rounded(data.stats(spark, sf_dir, 15).select(*PAIR, F.col("beta_origin").alias("beta")), "beta")


_POINTS = """points AS (SELECT leg_1, leg_2, pos, lag, spread - lag AS ret FROM (SELECT *, lag(spread) OVER (PARTITION BY leg_1, leg_2 ORDER BY pos) AS lag FROM resid) WHERE lag IS NOT NULL)"""
_HALF_LIFE = """hl AS (SELECT leg_1, leg_2, CASE WHEN mu >= 0 THEN 'Infinity'::DOUBLE ELSE -ln(2) / mu END AS half_life FROM (
  SELECT leg_1, leg_2, regr_slope(ret, lag) AS mu FROM (SELECT * FROM points UNION ALL SELECT * FROM points WHERE pos = 2) GROUP BY leg_1, leg_2))"""


@query(
    "half_life",
    over_pairs(
        f"SELECT leg_1, leg_2, {r('half_life')} AS half_life FROM hl", 15, sql.STATS, sql.RESIDUALS, _POINTS, _HALF_LIFE
    ),
)
def half_life(spark, sf_dir):
    spreads = discovery.residuals_of(data.pairs(spark, sf_dir, 15))
    return rounded(stats.half_life(spreads).select(*PAIR, "half_life"), "half_life")


@query(
    "adf_lag0",
    over_pairs(
        f"""SELECT leg_1, leg_2, n_obs, {r('slope')} AS slope, {r('slope / sqrt((syy - sxy * sxy / sxx) / (n_obs - 2) / sxx)')} AS adf_stat
        FROM (SELECT leg_1, leg_2, count(*) AS n_obs, regr_slope(ret, lag) AS slope, regr_sxx(ret, lag) AS sxx,
          regr_syy(ret, lag) AS syy, regr_sxy(ret, lag) AS sxy FROM points GROUP BY leg_1, leg_2)""",
        15,
        sql.STATS,
        sql.RESIDUALS,
        _POINTS,
    ),
)
def adf_lag0(spark, sf_dir):
    spreads = discovery.residuals_of(data.pairs(spark, sf_dir, 15))
    return rounded(stats.dickey_fuller_lag0(spreads), "slope", "adf_stat")


_ADF_BODY = f"""SELECT leg_1, leg_2, {r('stat')} AS adf_stat, {r('p')} AS p_value, used_lag::INTEGER AS used_lag, n_obs, p < 0.05 AS stationary
  FROM (SELECT *, {sql.p_value('stat', 1)} AS p FROM adf)"""


@query("adf_test", over_pairs(_ADF_BODY, 60, sql.STATS, sql.RESIDUALS, sql.adf("resid", True), recursive=True))
def adf_test(spark, sf_dir):
    spreads = discovery.residuals_of(data.pairs(spark, sf_dir))
    tested = stats.adf(spreads).withColumn("stationary", F.col("p_value") < 0.05)
    return rounded(tested, "adf_stat", "p_value")


COINT_CTES = [
    sql.STATS,
    sql.RESIDUALS,
    sql.adf("resid", False),
    f"coint AS MATERIALIZED (SELECT leg_1, leg_2, stat, used_lag, {sql.p_value('stat', 2)} AS p FROM adf)",
]


@query(
    "coint_test",
    over_pairs(
        f"""SELECT leg_1, leg_2, n, {r('corr')} AS corr, {r('stat')} AS coint_stat, {r('p')} AS p_value, used_lag::INTEGER AS used_lag
        FROM stats JOIN coint USING (leg_1, leg_2)""",
        60,
        *COINT_CTES,
        recursive=True,
    ),
)
def coint_test(spark, sf_dir):
    spreads = discovery.residuals_of(data.pairs(spark, sf_dir))
    tested = stats.coint(spreads, data.stats(spark, sf_dir).select(*PAIR, "n", "corr"))
    return rounded(tested, "corr", "coint_stat", "p_value")


@query(
    "spread_vol_pct",
    over_pairs(
        f"""SELECT leg_1, leg_2, {r('vol')} AS vol_pct FROM (SELECT leg_1, leg_2, stddev_samp(spread) / avg(y) AS vol
        FROM resid GROUP BY leg_1, leg_2)""",
        15,
        sql.STATS,
        sql.RESIDUALS,
    ),
)
def spread_vol_pct(spark, sf_dir):
    return rounded(data.stats(spark, sf_dir, 15).select(*PAIR, "vol_pct"), "vol_pct")


_SCAN_BODY = """SELECT leg_1 AS "Leg_1", leg_2 AS "Leg_2", round(corr, 3) AS "Correlation", round(p, 5) AS "Coint_Pvalue",
  round(half_life, 1) AS "Half_Life_Bars", round(beta, 3) AS "Hedge_Ratio"
  FROM stats JOIN hl USING (leg_1, leg_2) JOIN coint USING (leg_1, leg_2) WHERE n >= 30 AND corr >= 0.8"""


@query("pair_scan", over_pairs(_SCAN_BODY, 60, *COINT_CTES, _POINTS, _HALF_LIFE, recursive=True))
def pair_scan(spark, sf_dir):
    """Flagship. Row and p-value gates fit the synthetic series, which are random walks."""
    return discovery.pair_scan(
        data.closes(spark, sf_dir), min_rows=30, max_p=1.01, half_life_range=(0.0, 1e6), seconds=data.CHUNK_SECONDS
    )


# Pairs over the timestamps that all symbols share.
_SHARED = [
    sql.TICKS,
    sql.bars(60).replace("bars AS", "all_bars AS"),
    "bars AS MATERIALIZED (SELECT symbol, ts, close FROM all_bars WHERE ts IN (SELECT ts FROM all_bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM all_bars)))",
]


@query(
    "vol_scan",
    sql.query(
        *_SHARED,
        sql.PAIRS,
        *COINT_CTES,
        body=f"""SELECT leg_1 AS "Leg1", leg_2 AS "Leg2", {r('corr')} AS "Corr", {r('p')} AS "P_Value", {r('vol')} AS "Vol_Pct"
        FROM stats JOIN coint USING (leg_1, leg_2) JOIN (SELECT leg_1, leg_2, stddev_samp(spread) / avg(y) AS vol FROM resid GROUP BY ALL) USING (leg_1, leg_2)
        WHERE corr >= 0.8 ORDER BY vol DESC LIMIT 10""",
        recursive=True,
    ),
)
def vol_scan(spark, sf_dir):
    found = discovery.vol_scan(data.closes(spark, sf_dir), max_p=1.0, k=10, seconds=data.CHUNK_SECONDS)
    return rounded(found, "Corr", "P_Value", "Vol_Pct")


@query(
    "stationary_scan",
    sql.query(
        *_SHARED,
        sql.PAIRS.replace("a.symbol < b.symbol", "a.symbol <> b.symbol"),
        sql.STATS,
        sql.RESIDUALS,
        sql.adf("resid", True),
        body=f"""SELECT leg_1 || '-' || leg_2 AS "Pair", {r('beta')} AS "Hedge_Ratio", {r('p')} AS "P_Value", p < 0.05 AS "Stationary"
        FROM (SELECT *, {sql.p_value('stat', 1)} AS p FROM adf) JOIN stats USING (leg_1, leg_2)""",
        recursive=True,
    ),
)
def stationary_scan(spark, sf_dir):
    found = discovery.stationary_scan(data.closes(spark, sf_dir), seconds=data.CHUNK_SECONDS)
    return rounded(found, "Hedge_Ratio", "P_Value")


@query(
    "rank_thresholds",
    over_pairs(
        """SELECT leg_1, leg_2, round(corr, 3) AS corr, round(half_life, 1) AS half_life FROM stats JOIN hl USING (leg_1, leg_2)
        WHERE round(corr, 3) >= 0.8 AND round(half_life, 1) > 5 AND round(half_life, 1) < 1000""",
        15,
        sql.STATS,
        sql.RESIDUALS,
        _POINTS,
        _HALF_LIFE,
    ),
)
def rank_thresholds(spark, sf_dir):
    rows = data.pairs(spark, sf_dir, 15)
    found = stats.half_life(discovery.residuals_of(rows)).join(data.stats(spark, sf_dir, 15), PAIR)
    published = found.select(*PAIR, F.round("corr", 3).alias("corr"), F.round("half_life", 1).alias("half_life"))
    return discovery.within(published, min_corr=0.8, half_life_range=(5, 1000))


# ---- window functions ------------------------------------------------------------------------


@query(
    "gap_delta",
    "SELECT symbol, ts, prev_ts, (epoch_us(ts) - epoch_us(prev_ts)) / 1000000::DOUBLE AS gap_s FROM (SELECT event_type AS symbol, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev_ts FROM events)",
)
def gap_delta(spark, sf_dir):
    series = data.events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts")
    gaps = windows.gap_delta(series, seconds=data.DAY)
    return gaps.withColumn("gap_s", F.col("gap_us") / 1_000_000).drop("gap_us")


_GAPS = """gaps AS (SELECT symbol, prev_ts AS gap_start, ts AS gap_end, (epoch_us(ts) - epoch_us(prev_ts)) / 1000000::DOUBLE AS duration_s,
  epoch_us(ts) - epoch_us(prev_ts) > {alert} AS suspicious
  FROM (SELECT event_type AS symbol, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev_ts FROM events)
  WHERE epoch_us(ts) - epoch_us(prev_ts) > 300000000)"""


def _gaps(spark, sf_dir, alert_seconds):
    series = data.events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts")
    return windows.gap_report(series, 300, alert_seconds, seconds=data.DAY)


@query(
    "gap_report",
    sql.query(
        _GAPS.format(alert=4 * 86_400_000_000),
        body="""SELECT symbol, strftime(gap_start, '%Y-%m-%d %H:%M') AS gap_start, strftime(gap_end, '%Y-%m-%d %H:%M') AS gap_end, duration_s FROM gaps""",
    ),
)
def gap_report(spark, sf_dir):
    shape = "yyyy-MM-dd HH:mm"
    return _gaps(spark, sf_dir, 4 * data.DAY).select(
        "symbol",
        F.date_format("gap_start", shape).alias("gap_start"),
        F.date_format("gap_end", shape).alias("gap_end"),
        "duration_s",
    )


@query(
    "gap_alert",
    sql.query(
        _GAPS.format(alert=7_200_000_000),
        body="SELECT count(*) AS n_gaps, count_if(suspicious)::BIGINT AS n_suspicious, coalesce(bool_or(suspicious), false) AS alert FROM gaps",
    ),
)
def gap_alert(spark, sf_dir):
    return windows.gap_verdict(_gaps(spark, sf_dir, 7200))


@query(
    "pct_change",
    over_bars(
        f"SELECT symbol, ts, {r('ret', 9)} AS ret FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) WHERE ret IS NOT NULL",
        15,
    ),
)
def pct_change(spark, sf_dir):
    return rounded(windows.pct_change(data.closes(spark, sf_dir, 15), seconds=data.CHUNK_SECONDS), "ret", digits=9)


@query(
    "rolling_z",
    over_pairs(
        f"SELECT leg_1, leg_2, ts, {r('rolling_z')} AS rolling_z FROM scored",
        60,
        sql.STATS,
        sql.RESIDUALS,
        sql.rolling("resid", "leg_1, leg_2"),
    ),
)
def rolling_z(spark, sf_dir):
    spreads = discovery.residuals_of(data.pairs(spark, sf_dir))
    z = windows.rolling_z(spreads, PAIR, block_rows=256)
    return rounded(z.select(*PAIR, "ts", "rolling_z"), "rolling_z")


@query(
    "rolling_z_pop",
    over_pairs(
        f"""SELECT leg_1, leg_2, ts, {r('z')} AS z_score FROM (SELECT leg_1, leg_2, ts, CASE WHEN n >= 20 THEN (spread - m) / nullif(s, 0) END AS z
        FROM (SELECT leg_1, leg_2, ts, spread, count(*) OVER w AS n, avg(spread) OVER w AS m, stddev_pop(spread) OVER w AS s
          FROM (SELECT *, y - 1.25::DOUBLE * x AS spread FROM pairs)
          WINDOW w AS (PARTITION BY leg_1, leg_2 ORDER BY pos ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)))"""
    ),
)
def rolling_z_pop(spark, sf_dir):
    rows = data.pairs(spark, sf_dir).withColumn("spread", F.col("y") - 1.25 * F.col("x"))
    z = windows.rolling_z(rows, PAIR, "spread", 40, ddof=0, min_obs=20, out="z_score", block_rows=256)
    return rounded(z.select(*PAIR, "ts", "z_score"), "z_score")


@query(
    "demean",
    over_pairs(f"SELECT leg_1, leg_2, ts, {r('y - avg(y) OVER (PARTITION BY leg_1, leg_2)')} AS y0 FROM pairs", 15),
)
def demean(spark, sf_dir):
    rows = data.pairs(spark, sf_dir, 15).select(*PAIR, "ts", "y")
    return rounded(windows.demean(rows, PAIR, "y", "y0").select(*PAIR, "ts", "y0"), "y0")


@query("row_position", over_bars("SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM bars", 15))
def row_position(spark, sf_dir):
    series = data.closes(spark, sf_dir, 15).select("symbol", "ts")
    return with_position(series, ["symbol"], ["ts"], "pos", data.CHUNK_SECONDS)


# ---- order and rankings ----------------------------------------------------------------------


@query("sort_ts", over_bars("SELECT symbol, ts, close FROM bars ORDER BY ts, symbol", 15))
def sort_ts(spark, sf_dir):
    return data.closes(spark, sf_dir, 15).orderBy("ts", "symbol")


@query(
    "tail_n",
    over_bars(
        "SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 500", 15
    ),
)
def tail_n(spark, sf_dir):
    return windows.tail_n(data.closes(spark, sf_dir, 15), 500, seconds=data.CHUNK_SECONDS)


@query(
    "head_n",
    over_bars("SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 5", 15),
)
def head_n(spark, sf_dir):
    return windows.head_n(data.closes(spark, sf_dir, 15), 5, seconds=data.CHUNK_SECONDS)


@query(
    "topk_desc",
    sql.query(
        _GAPS.format(alert=4 * 86_400_000_000),
        body="SELECT symbol, gap_start, gap_end, duration_s FROM gaps ORDER BY duration_s DESC, symbol, gap_end LIMIT 10",
    ),
)
def topk_desc(spark, sf_dir):
    gaps = _gaps(spark, sf_dir, 4 * data.DAY).drop("suspicious")
    return windows.top_k(gaps, 10, [F.desc("duration_s"), "symbol", "gap_end"])


@query(
    "topk_asc",
    sql.query(_PERF, body="SELECT custkey, CAST(net AS BIGINT) AS net FROM perf ORDER BY net, custkey LIMIT 10"),
)
def topk_asc(spark, sf_dir):
    return windows.top_k(customer_totals(spark, sf_dir), 10, ["net", "custkey"])


@query("top_bottom_k", sql.query(_PERF, body=_TOP_BOTTOM.format(k=3)))
def top_bottom_k(spark, sf_dir):
    return windows.top_bottom_k(customer_totals(spark, sf_dir), 3, "net", "custkey")
