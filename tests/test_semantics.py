"""Hand-made cases for cleaning, alignment, signals and PnL."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tests.helpers import at, frame, from_pandas, walk_pairs
from tidepair.operators import align, clean, pnl, signals, windows
from tidepair.operators.ordered import DAY
from tidepair.sources import bars as store
from tidepair.sources.schemas import BARS


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_end_bound(spark):
    df = frame(spark, [("a", "2024-12-31 00:00:00"), ("a", "2024-12-31 10:00:00")], "symbol string, ts timestamp")
    assert store.slice_time(df, end="2024-12-31").count() == 1
    assert store.slice_time(df, end="2024-12-31", end_day_inclusive=True).count() == 2


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 6.0)], "symbol string, ts int, seq int, close double")
    assert clean.dedupe(df, ["symbol", "ts"], "seq", "last").first()["close"] == 6.0
    assert clean.dedupe(df, ["symbol", "ts"], "seq", "first").first()["close"] == 5.0


def test_missing_columns_are_filled_and_nulls_kept(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, None, 3.0)], "o double, h double, l double, c double, v double")
    row = clean.normalize_bars(df).first()
    assert row["vwap"] == 0.0 and row["close"] is None and row["volume"] == 3.0


def test_range_upsert(spark):
    minute = lambda m: f"2024-01-01 00:{m:02d}:00"
    schema = "symbol string, ts timestamp, close double"
    target = frame(spark, [("a", minute(m), 1.0) for m in range(1, 11)] + [("b", minute(5), 1.0)], schema)
    patch = frame(spark, [("a", minute(4), 2.0), ("a", minute(6), 2.0), ("c", minute(1), 2.0)], schema)
    once = clean.range_upsert(target, patch)
    got = [(s, t.minute, c) for s, t, c in rows(once, "symbol", "ts", "close")]
    assert [m for s, m, _ in got if s == "a"] == [1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert ("b", 5, 1.0) in got and ("c", 1, 2.0) in got and ("a", 4, 2.0) in got
    assert rows(clean.range_upsert(once, patch), "symbol", "ts", "close") == rows(once, "symbol", "ts", "close")


def test_gaps(spark):
    base = at("2024-01-01")
    stamps = [base + pd.Timedelta(minutes=m) for m in (0, 1, 7, 8)] + [base + pd.Timedelta(days=5, minutes=8)]
    df = from_pandas(spark, pd.DataFrame({"symbol": "a", "ts": stamps}))
    report = windows.gap_report(df, seconds=120)
    got = [(r["gap_start"].minute, r["duration_s"], r["suspicious"]) for r in report.orderBy("gap_end").collect()]
    assert got == [(1, 360.0, False), (8, 5 * 86400.0, True)]
    verdict = windows.gap_verdict(report).first()
    assert (verdict["n_gaps"], verdict["n_suspicious"], verdict["alert"]) == (2, 1, True)


def test_gap_of_every_row(spark):
    """Copies of a timestamp are rows of their own, as they are to the SQL."""
    stamps = ["2024-01-01 00:00:00"] * 3 + ["2024-01-01 00:10:00", "2024-01-02 00:10:00", "2024-01-02 00:10:00"]
    df = frame(spark, [("a", t) for t in stamps] + [("b", stamps[0])], "symbol string, ts timestamp")
    for seconds in (60, DAY):
        found = windows.gap_delta(df, seconds=seconds).orderBy("symbol", "ts", F.desc("gap_us")).collect()
        got = [(r["symbol"], r["gap_us"], r["prev_ts"] and r["prev_ts"].minute) for r in found]
        day = DAY * 1_000_000
        assert got == [("a", 0, 0), ("a", 0, 0), ("a", None, None), ("a", 600_000_000, 0), ("a", day, 10), ("a", 0, 10), ("b", None, None)]
    assert windows.gap_report(df, 300).count() == 2


def test_asof(spark):
    df = frame(
        spark,
        [("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 10:02:00", None), ("a", "2024-01-01 10:05:00", 2.0)],
        "symbol string, ts timestamp, close double",
    )
    assert align.asof_value(df, "2024-01-01 10:03:00").first()["close"] == 1.0
    probes = frame(spark, [("a", "2024-01-01 09:00:00"), ("a", "2024-01-01 10:03:00"), ("a", "2024-01-02 10:05:00")], "symbol string, ts timestamp")
    for seconds in (60, DAY):
        got = [r["close"] for r in align.asof_join(df, probes, seconds=seconds).orderBy("ts").collect()]
        assert got == [None, 1.0, 2.0]


def test_outer_ffill_case(spark):
    df = frame(
        spark,
        [("A", "2024-01-01 01:00:00", 1.0), ("A", "2024-01-01 03:00:00", 3.0), ("B", "2024-01-01 02:00:00", 2.0)],
        "symbol string, ts timestamp, close double",
    )
    for seconds in (1800, DAY):
        got = [(s, t.hour, c) for s, t, c in rows(align.align_outer_ffill(df, seconds=seconds), "symbol", "ts", "close")]
        assert got == [("A", 2, 1.0), ("A", 3, 3.0), ("B", 2, 2.0), ("B", 3, 2.0)]


@pytest.mark.parametrize("seconds", [3600, 5 * DAY])
def test_outer_ffill_random(spark, seconds):
    rng = np.random.default_rng(6)
    stamps = pd.date_range("2024-01-01", periods=200, freq="20min")
    parts = [
        pd.DataFrame({"symbol": s, "ts": stamps[np.sort(rng.choice(200, k, replace=False))]}).assign(
            close=lambda d: rng.normal(size=len(d))
        )
        for s, k in (("a", 150), ("b", 12), ("c", 3))
    ]
    long = pd.concat(parts, ignore_index=True)
    wide = long.pivot(index="ts", columns="symbol", values="close").ffill().dropna()
    want = wide.stack().rename("close").reset_index().sort_values(["symbol", "ts"], ignore_index=True)
    got = align.align_outer_ffill(from_pandas(spark, long), seconds=seconds).toPandas()
    got = got.sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(want)
    np.testing.assert_array_equal(got["close"], want["close"])


def test_resample_takes_last_value_that_is_not_null(spark):
    df = frame(
        spark,
        [("a", "2024-01-01 00:07:00", 1.0), ("a", "2024-01-01 00:14:00", None), ("a", "2024-01-01 00:15:00", 3.0)],
        "symbol string, ts timestamp, close double",
    )
    got = align.resample_last(df, "15 minutes").orderBy("ts").collect()
    assert [(r["ts"].minute, r["close"]) for r in got] == [(0, 1.0), (15, 3.0)]


def test_rolling_z_warmup(spark):
    pdf = walk_pairs(31).assign(spread=np.arange(31.0))
    df = from_pandas(spark, pdf)
    sample = windows.rolling_z(df, ["leg_1"]).orderBy("pos").toPandas()["rolling_z"]
    assert sample.isna().sum() == 29 and not np.isnan(sample[29])
    population = windows.rolling_z(df, ["leg_1"], ddof=0, min_obs=20).orderBy("pos").toPandas()["rolling_z"]
    assert population.isna().sum() == 19
    flat = windows.rolling_z(df.withColumn("spread", F.lit(1.0)), ["leg_1"]).toPandas()["rolling_z"]
    assert flat.isna().all()


def test_ticker_filter(spark):
    df = spark.createDataFrame([("C:EURUSD",), ("C:USDAED",), ("X:BTCUSD",), ("C:EURUSDX",)], "ticker string")
    assert rows(clean.liquid_tickers(df), "ticker") == [("C:EURUSD",)]


def test_ticks(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, nan), (1, 0.0), (1, -1.0), (1, None), (9, 5.0), (1, 5.0)], "con_id long, price double"
    )
    known = spark.createDataFrame([(1, "K")], "con_id long, key string")
    assert rows(clean.valid_ticks(df, known), "key", "price") == [("K", 5.0)]


def test_tail_and_head_by_row(spark):
    stamps = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-03-05", "2024-03-06", "2024-12-01"])
    df = from_pandas(spark, pd.DataFrame({"symbol": "a", "ts": stamps}))
    assert [r["ts"].month for r in windows.tail_n(df, 3, seconds=DAY).orderBy("ts").collect()] == [3, 3, 12]
    assert [r["ts"].day for r in windows.head_n(df, 2, seconds=DAY).orderBy("ts").collect()] == [1, 2]


def test_kelly_and_sizes(spark):
    trades = spark.createDataFrame([("A", "B", v) for v in (2.0, 2.0, -1.0, 0.0)], "leg_1 string, leg_2 string, pnl double")
    sized = pnl.kelly(pnl.trade_stats(trades, ["leg_1", "leg_2"]))
    row = sized.first()
    assert row["win_rate"] == pytest.approx(2 / 3) and row["reward_risk"] == 2.0
    assert row["kelly"] == pytest.approx(0.5) and row["half_kelly"] == pytest.approx(0.25) and row["tradable"]
    last = spark.createDataFrame([("A", "B", 99.0, 50.0, 1.7)], "leg_1 string, leg_2 string, y double, x double, beta double")
    shares = pnl.position_size(sized, last, 100_000.0).first()
    assert (shares["shares_y"], shares["shares_x"]) == (252, 428)


def test_costs():
    assert pnl.round_trip_cost(150, 858) == pytest.approx(30.24)
    assert pnl.round_trip_cost(100, 100) == pytest.approx(6.0)
    assert pnl.break_even(5.7) == pytest.approx(0.201)


def test_zero_trade_combination_survives(spark):
    grid = pnl.with_grid(spark.createDataFrame([("A", "B")], "leg_1 string, leg_2 string"), entry=[2, 9], exit=[0])
    events = spark.createDataFrame(
        [("A", "B", 2.0, 0.0, True, 3.0), ("A", "B", 9.0, 0.0, False, 0.0)],
        "leg_1 string, leg_2 string, entry double, exit double, is_exit boolean, points double",
    )
    got = pnl.grid_summary(events, grid, ["leg_1", "leg_2", "entry", "exit"], 10, 4.0)
    assert rows(got, "entry", "trades", "gross_pnl", "net_pnl", "avg_net_per_trade") == [
        (2.0, 1, 30.0, 26.0, 26.0),
        (9.0, 0, 0.0, 0.0, 0.0),
    ]


def test_portfolio_adds_up(spark):
    rng = np.random.default_rng(2)
    stamps = pd.date_range("2024-01-01", periods=120, freq="h")
    parts = [
        pd.DataFrame({"leg_1": a, "leg_2": "Z", "ts": stamps, "pnl": rng.normal(size=120).round(2)}) for a in "abcdef"
    ]
    long = pd.concat(parts)
    df = from_pandas(spark, long)
    card = pnl.scorecard(df, seconds=7200).first()
    curve = long.groupby("ts")["pnl"].sum().cumsum()
    assert card["total_pnl"] == pytest.approx(curve.iloc[-1])
    assert card["max_drawdown"] == pytest.approx((curve - curve.cummax()).min())
    assert card["n_pairs"] == 6 and card["diversified"]
    assert card["winning_pairs"] == (long.groupby("leg_1")["pnl"].sum() > 0).sum()


SIGNAL_SCHEMA = (
    "leg_1 string, leg_2 string, ts int, signal_type string, "
    "orders array<struct<key string, action string, qty double, type string>>"
)


def test_gate_and_order_types(spark):
    orders = [("A", "BUY", 10.0, "MKT"), ("B", "SELL", 5.0, "LMT")]
    kinds = ["HOLD", "EXIT", None, "WHAT", "LONG_SPREAD"]
    df = spark.createDataFrame([("A", "B", i, k, orders) for i, k in enumerate(kinds)], SIGNAL_SCHEMA)
    passed = signals.allowed(df, ["LONG_SPREAD", "SHORT_SPREAD", "EXIT"])
    assert rows(passed, "signal_type") == [("EXIT",), ("LONG_SPREAD",)]
    assert signals.rejected(df, ["LONG_SPREAD", "SHORT_SPREAD", "EXIT"]).count() == 3
    sent, refused = signals.order_intents(passed.where("signal_type = 'EXIT'"))
    assert rows(sent, "asset", "type") == [("A", "MKT")] and rows(refused, "asset", "type") == [("B", "LMT")]


def test_hedge_quantity_follows_or_tracks(spark):
    events = frame(
        spark,
        [
            ("A", "B", "2024-01-01 00:00:00", 1, False, -3.0, 1.55, 10.0, 5.0, 0.1),
            ("A", "B", "2024-01-01 01:00:00", 1, True, 0.1, 2.05, 11.0, 5.0, 0.1),
        ],
        "leg_1 string, leg_2 string, ts timestamp, side int, is_exit boolean, z_score double, beta double, y double, x double, error double",
    )
    for track, want in ((False, [15.0, 20.0]), (True, [15.0, 15.0])):
        got = signals.kalman_signals(events, 10, track).orderBy("ts").collect()
        assert [r["orders"][1]["qty"] for r in got] == want
        assert [r["orders"][0]["action"] for r in got] == ["BUY", "SELL"]
        assert [r["signal_type"] for r in got] == ["ENTRY_LONG_SPREAD", "EXIT_ALL"]


def test_library_round_trip(spark, tmp_path):
    path = str(tmp_path / "lib")
    pdf = pd.DataFrame({"symbol": ["a", "a", "b"], "ts": pd.date_range("2024-01-01", periods=3, freq="400D")})
    for c in ("open", "high", "low", "close", "volume", "vwap"):
        pdf[c] = [1.0, 2.0, 3.0]
    df = from_pandas(spark, pdf)
    store.save_bars(df, path)
    store.save_bars(df.where("symbol = 'b'").withColumn("close", F.lit(9.0)), path)
    store.save_bars(df.where("false"), path)
    library = store.read_library(spark, path)
    assert rows(library, "symbol", "close") == [("a", 1.0), ("a", 2.0), ("b", 9.0)]
    assert {f.name for f in library.schema} == {f.name for f in BARS}
    assert store.load_bars(spark, path, ["a", "zz"], end="2024-06-01").count() == 1
    assert store.has_symbol(library, "a") and not store.has_symbol(library, "zz")
    plan = store.load_bars(spark, path, ["a"], "2024-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan or "symbol#" in plan.split("PartitionFilters")[1][:80]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_wide_edge(spark):
    df = frame(
        spark,
        [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 2.0), ("a", "2024-01-02 00:00:00", 3.0)],
        "symbol string, ts timestamp, close double",
    )
    got = align.to_wide(df, ["a", "b"]).orderBy("ts").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1.0, 2.0), (3.0, None)]


def test_orders_fill_at_their_bar(spark):
    orders = frame(spark, [("a", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-03 00:00:00", 5.0)], "key string, ts timestamp, qty double")
    prices = frame(spark, [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-02 00:00:00", 2.0)], "symbol string, ts timestamp, close double")
    assert rows(signals.price_ledger(orders, prices), "key", "qty", "price") == [("a", 5.0, 1.0)]
