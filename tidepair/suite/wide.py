"""Pair discovery over a wide universe: one series a supplier, with gates that drop pairs.

A supplier's price is a running sum of the quantities it ships, a week a bar. All suppliers
count; pairs correlate from strongly negative to strongly positive.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepair.operators import pairs, tiles, windows
from tidepair.operators.ordered import DAY, with_running_sum
from tidepair.operators.pairs import PAIR
from tidepair.plans import discovery
from tidepair.session import scratch_path
from tidepair.sources import bars as store
from tidepair.suite import data, sql
from tidepair.suite.registry import query, rounded
from tidepair.suite.sql import r
from tidepair.suite.statistics import COINT_CTES, _HALF_LIFE, _POINTS

YEAR = 365 * DAY
TAIL, MIN_ROWS, MIN_CORR, MAX_P, HALF_LIFE = 300, 60, 0.8, 0.05, (2.0, 25.0)

_BARS = f"""bars AS MATERIALIZED (SELECT symbol, ts, close FROM (
  SELECT symbol, ts, (1000000 + sum(move) OVER (PARTITION BY symbol ORDER BY ts))::DOUBLE / 100 AS close,
    row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back
  FROM (SELECT 'S' || l_suppkey AS symbol, date_trunc('week', l_shipdate) AS ts, sum(round(l_quantity * 100)::BIGINT - 2550) AS move
    FROM lineitem GROUP BY ALL)) WHERE back <= {TAIL})"""
_GATE = f"n >= {MIN_ROWS} AND corr >= {MIN_CORR}"


def weekly(spark, sf_dir):
    """All weekly closes of every supplier."""
    move = F.round(F.col("l_quantity") * 100).cast("bigint") - 2550
    week = F.date_trunc("week", "l_shipdate").cast("timestamp")
    items = data.table(spark, sf_dir, "lineitem")
    moves = items.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), week.alias("ts")).agg(F.sum(move).alias("move"))
    summed = with_running_sum(moves, ["symbol"], ["ts"], {"sum": "move"}, YEAR)
    return summed.select("symbol", "ts", ((F.col("sum") + 1_000_000) / 100).alias("close"))


def closes(spark, sf_dir):
    """The last ``TAIL`` weekly closes of every supplier."""
    build = lambda: windows.tail_n(weekly(spark, sf_dir), TAIL, seconds=YEAR)
    return data._stored(spark, sf_dir, "wide", build, "lineitem")


@query(
    "wide_pair_corr",
    sql.query(_BARS, sql.PAIRS, sql.STATS, body=f"SELECT leg_1, leg_2, n, {r('corr')} AS corr, {r('beta')} AS beta FROM stats WHERE {_GATE}"),
)
def wide_pair_corr(spark, sf_dir):
    """Pairs of all suppliers that pass the row and correlation gates, with their hedge ratio."""
    found = pairs.hedge_stats(tiles.gated_moments(closes(spark, sf_dir), min_rows=MIN_ROWS, min_corr=MIN_CORR))
    return rounded(found.select(*PAIR, "n", "corr", "beta"), "corr", "beta")


@query(
    "wide_pair_rows",
    sql.query(
        _BARS,
        sql.PAIRS,
        sql.STATS,
        body=f"SELECT leg_1, leg_2, ts, pos, y, x, {r('y - alpha - beta * x', 4)} AS spread FROM pairs JOIN stats USING (leg_1, leg_2) WHERE {_GATE}",
    ),
)
def wide_pair_rows(spark, sf_dir):
    """Numbered rows and residuals of the gated pairs alone: they leave the tile that holds both legs."""
    rows = tiles.gated_rows(closes(spark, sf_dir), min_rows=MIN_ROWS, min_corr=MIN_CORR)
    return rounded(rows, "spread", digits=4)


def _scan_sql(*rows: str) -> str:
    """The scan over CTEs that end in the aligned rows of all pairs."""
    return sql.query(
        *rows,
        COINT_CTES[0],
        # Only pairs that pass the cheap gates are tested.
        COINT_CTES[1].replace("FROM pairs JOIN stats USING (leg_1, leg_2)", f"FROM pairs JOIN stats USING (leg_1, leg_2) WHERE {_GATE}"),
        *COINT_CTES[2:],
        _POINTS,
        _HALF_LIFE,
        body=f"""SELECT * FROM (SELECT leg_1 AS "Leg_1", leg_2 AS "Leg_2", round(corr, 3) AS "Correlation", round(p, 5) AS "Coint_Pvalue",
  round(half_life, 1) AS "Half_Life_Bars", round(beta, 3) AS "Hedge_Ratio"
  FROM stats JOIN hl USING (leg_1, leg_2) JOIN coint USING (leg_1, leg_2))
  WHERE "Coint_Pvalue" < {MAX_P} AND "Half_Life_Bars" > {HALF_LIFE[0]} AND "Half_Life_Bars" < {HALF_LIFE[1]}""",
        recursive=True,
    )


_SCAN = _scan_sql(_BARS, sql.PAIRS)


def _scan(spark, sf_dir):
    return discovery.pair_scan(closes(spark, sf_dir), MIN_ROWS, MIN_CORR, MAX_P, HALF_LIFE, seconds=YEAR, wide=True)


@query("wide_pair_scan", _SCAN)
def wide_pair_scan(spark, sf_dir):
    """The flagship over all suppliers: row, correlation, p-value and half-life gates all drop pairs."""
    return _scan(spark, sf_dir)


@query("wide_scan_export", _SCAN)
def wide_scan_export(spark, sf_dir):
    """The ranking of the scan as a CSV report, read back."""
    found = _scan(spark, sf_dir)
    path = scratch_path(spark, "ranking")
    store.write_csv(found, path)
    return spark.read.schema(found.schema).option("header", True).csv(path)


# Legs in catalogue order: the supplier with the lower balance comes first.
_RANKED = "ranked AS (SELECT 'S' || s_suppkey AS symbol, s_acctbal AS rank FROM supplier)"
_CATALOGUE_PAIRS = sql.PAIRS.replace(
    "FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol",
    """FROM bars a JOIN ranked ra ON ra.symbol = a.symbol JOIN bars b ON a.ts = b.ts JOIN ranked rb ON rb.symbol = b.symbol
  WHERE ra.rank < rb.rank OR (ra.rank = rb.rank AND a.symbol < b.symbol)""",
)


@query("wide_catalogue_scan", _scan_sql(_BARS, _RANKED, _CATALOGUE_PAIRS))
def wide_catalogue_scan(spark, sf_dir):
    """The scan over each series' own last rows, its legs in catalogue order: tails, ranks and all gates in one plan."""
    suppliers = data.table(spark, sf_dir, "supplier")
    rank = suppliers.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_acctbal").alias("rank"))
    return discovery.pair_scan(weekly(spark, sf_dir), MIN_ROWS, MIN_CORR, MAX_P, HALF_LIFE, tail_rows=TAIL, rank=rank, seconds=YEAR, wide=True)
