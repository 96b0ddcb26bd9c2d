"""Joins, alignment and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepair.operators import align, pairs, pnl, signals
from tidepair.operators.pairs import PAIR
from tidepair.operators.windows import top_bottom_k
from tidepair.suite import data, sql
from tidepair.suite.registry import query, rounded
from tidepair.suite.scans import INSTRUMENTS_SQL, instruments
from tidepair.suite.sql import over_bars, over_pairs, r


@query(
    "resample_last",
    sql.query(
        sql.TICKS,
        body=" UNION ALL ".join(
            f"SELECT '{w} minutes' AS width, symbol, {sql.bucket(w)} AS ts, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY ALL"
            for w in (5, 15, 60)
        ),
    ),
)
def resample_last(spark, sf_dir):
    ticks = data.ticks(spark, sf_dir)
    parts = [
        align.resample_last(ticks, width, "price").withColumn("width", F.lit(width))
        for width in ("5 minutes", "15 minutes", "60 minutes")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("align_inner_pair", over_pairs("SELECT leg_1, leg_2, ts, y, x FROM pairs QUALIFY count(*) OVER (PARTITION BY leg_1, leg_2) >= 640"))
def align_inner_pair(spark, sf_dir):
    closes = data.closes(spark, sf_dir)
    chosen = pairs.list_pairs(closes, min_rows=640).select(*PAIR)
    return pairs.pair_bars(closes, chosen)


@query(
    "align_inner_all",
    over_bars(
        "SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))"
    ),
)
def align_inner_all(spark, sf_dir):
    return align.align_inner_all(data.closes(spark, sf_dir)).select("symbol", "ts", "close")


@query(
    "align_left",
    over_bars(
        "SELECT a.ts, a.symbol AS leg_1, a.close AS y, b.symbol AS leg_2, b.close AS x FROM bars a LEFT JOIN bars b ON a.ts = b.ts AND b.symbol = 'view' WHERE a.symbol <> 'view'"
    ),
)
def align_left(spark, sf_dir):
    closes = data.closes(spark, sf_dir)
    y = closes.where(F.col("symbol") != "view").select("ts", F.col("symbol").alias("leg_1"), F.col("close").alias("y"))
    x = closes.where(F.col("symbol") == "view").select("ts", F.col("symbol").alias("leg_2"), F.col("close").alias("x"))
    return align.align_left(y, x)


FFILL_SQL = """grid AS (SELECT s.symbol, t.ts, b.close FROM (SELECT DISTINCT ts FROM bars) t, (SELECT DISTINCT symbol FROM bars) s
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts),
filled AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close FROM grid),
ready AS (SELECT max(t) AS t FROM (SELECT min(ts) AS t FROM bars GROUP BY symbol))"""


@query(
    "align_outer_ffill",
    over_bars("SELECT symbol, ts, close FROM filled WHERE ts >= (SELECT t FROM ready)", 15, FFILL_SQL),
)
def align_outer_ffill(spark, sf_dir):
    return align.align_outer_ffill(data.closes(spark, sf_dir, 15), seconds=data.CHUNK_SECONDS)


@query(
    "aligned_wide",
    over_bars(
        """SELECT ts, max(CASE WHEN symbol = 'click' THEN close END) AS click, max(CASE WHEN symbol = 'view' THEN close END) AS view
        FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)) GROUP BY ts""",
        15,
    ),
)
def aligned_wide(spark, sf_dir):
    """Closes at the timestamps that all symbols share, one column for each named symbol."""
    shared = align.align_inner_all(data.closes(spark, sf_dir, 15))
    return align.to_wide(shared, ["click", "view"])


@query(
    "readiness_gate",
    over_bars(
        """SELECT DISTINCT ts FROM bars WHERE ts >= (SELECT max(t) FROM (SELECT min(ts) AS t FROM bars GROUP BY symbol))
        AND (SELECT count(DISTINCT symbol) FROM bars) = 5""",
        15,
    ),
)
def readiness_gate(spark, sf_dir):
    return align.ready_timestamps(data.closes(spark, sf_dir, 15), n_instruments=5)


@query("pair_self_join", over_pairs("SELECT leg_1, leg_2, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30", 15))
def pair_self_join(spark, sf_dir):
    return pairs.list_pairs(data.closes(spark, sf_dir, 15), min_rows=30)


@query(
    "pair_both_directions",
    over_bars(
        f"""SELECT a.symbol || '-' || b.symbol AS pair, count(*) AS n, {r('regr_slope(a.close, b.close)')} AS hedge_ratio
        FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol <> b.symbol GROUP BY a.symbol, b.symbol"""
    ),
)
def pair_both_directions(spark, sf_dir):
    both = pairs.both_directions(pairs.pair_moments(data.closes(spark, sf_dir)))
    lines = pairs.hedge_stats(both).select(
        F.concat_ws("-", *PAIR).alias("pair"), "n", F.col("beta").alias("hedge_ratio")
    )
    return rounded(lines, "hedge_ratio")


@query(
    "asof_lookup",
    over_bars(
        "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM bars WHERE ts <= TIMESTAMP '2024-01-15 07:50:00' GROUP BY symbol",
        15,
    ),
)
def asof_lookup(spark, sf_dir):
    return align.asof_value(data.closes(spark, sf_dir, 15), "2024-01-15 07:50:00")


@query(
    "asof_join",
    over_bars(
        "SELECT p.event_type AS symbol, p.ts, b.close FROM events p ASOF LEFT JOIN bars b ON p.event_type = b.symbol AND p.ts >= b.ts"
    ),
)
def asof_join(spark, sf_dir):
    probes = data.events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts")
    return align.asof_join(data.closes(spark, sf_dir), probes, seconds=data.CHUNK_SECONDS)


@query(
    "exact_and_next",
    over_bars(
        """SELECT * FROM (SELECT symbol, ts, close, lead(ts) OVER w AS next_ts, lead(close) OVER w AS next_close FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE ts = TIMESTAMP '2024-01-17 17:00:00'"""
    ),
)
def exact_and_next(spark, sf_dir):
    return align.exact_and_next(data.closes(spark, sf_dir), "2024-01-17 17:00:00")


@query(
    "nearby_window",
    over_bars(
        "SELECT symbol, ts, close FROM bars WHERE ts >= TIMESTAMP '2024-01-16 17:07:00' AND ts <= TIMESTAMP '2024-01-18 17:07:00'",
        15,
    ),
)
def nearby_window(spark, sf_dir):
    return align.nearby(data.closes(spark, sf_dir, 15), "2024-01-17 17:07:00")


_GRID = "(VALUES (1e-6), (5e-6), (1e-5)) d(delta), (VALUES (4.5), (5.5), (6.5)) e(entry), (VALUES (0.0), (0.5), (1.0)) x(exit)"


@query(
    "param_grid",
    over_pairs(
        f"SELECT leg_1, leg_2, delta::DOUBLE AS delta, entry::DOUBLE AS entry, exit::DOUBLE AS exit FROM (SELECT DISTINCT leg_1, leg_2 FROM pairs), {_GRID}"
    ),
)
def param_grid(spark, sf_dir):
    known = pairs.list_pairs(data.closes(spark, sf_dir)).select(*PAIR)
    return pnl.with_grid(known, delta=[1e-6, 5e-6, 1e-5], entry=[4.5, 5.5, 6.5], exit=[0.0, 0.5, 1.0])


@query(
    "instrument_lookup",
    sql.query(
        INSTRUMENTS_SQL,
        body="""SELECT c_custkey, c.c_mktsegment AS contract, f.key FROM customer c
        LEFT JOIN (SELECT contract, arg_min(key, position) AS key FROM instruments GROUP BY contract) f ON f.contract = c.c_mktsegment""",
    ),
)
def instrument_lookup(spark, sf_dir):
    contracts = data.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("contract"))
    return signals.instrument_of(contracts, instruments(spark, sf_dir))


@query("index_union", over_bars("SELECT DISTINCT ts FROM bars", 15))
def index_union(spark, sf_dir):
    return data.closes(spark, sf_dir, 15).select("ts").distinct()


@query(
    "index_intersect",
    over_bars(
        """SELECT ts FROM bars WHERE symbol = 'click' INTERSECT SELECT ts FROM bars WHERE symbol = 'view'""", 15
    ),
)
def index_intersect(spark, sf_dir):
    closes = data.closes(spark, sf_dir, 15)
    legs = [closes.where(F.col("symbol") == s).select("ts") for s in ("click", "view")]
    return legs[0].intersect(legs[1])


_PERF = """perf AS (SELECT o_custkey AS custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS net FROM orders GROUP BY o_custkey)"""


def customer_totals(spark, sf_dir):
    """Totals in whole cents per customer: a ranking input with many rows."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    orders = data.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), cents.alias("c"))
    return orders.groupBy("custkey").agg(F.sum("c").alias("net"))


_TOP_BOTTOM = """SELECT custkey, CAST(net AS BIGINT) AS net, 'top' AS side FROM (SELECT * FROM perf ORDER BY net DESC, custkey LIMIT {k})
  UNION ALL SELECT custkey, CAST(net AS BIGINT), 'bottom' FROM (SELECT * FROM perf ORDER BY net, custkey DESC LIMIT {k})"""


@query("highlight_union", sql.query(_PERF, body=_TOP_BOTTOM.format(k=10)))
def highlight_union(spark, sf_dir):
    return top_bottom_k(customer_totals(spark, sf_dir), 10, "net", "custkey")
