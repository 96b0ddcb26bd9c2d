"""Strategies split in time, the board's ledger, gated pair rows and derived tables."""

import numpy as np
import pandas as pd
import pytest

from tests.helpers import from_pandas, walk_pairs
from tidepair.operators import align, pairs, signals
from tidepair.plans import research
from tidepair.plans.strategies import Tracks, run_strategy, walk_strategy
from tidepair.streaming.processors import POSITIONED, REVERSION, SNAPSHOT, MeanReversionStrategy, PositionedReversion, PriceBoard

KEY = ["leg_1", "leg_2"]


@pytest.fixture(scope="module")
def hot():
    """One hot pair and a short one."""
    one = walk_pairs(2500, seed=3, step="1min")
    two = walk_pairs(90, seed=4, step="1min").assign(leg_2="C")
    return pd.concat([one, two], ignore_index=True)[[*KEY, "ts", "y", "x"]]


def same(got, want):
    key = [*KEY, "ts", "signal_type"]
    got, want = (d.toPandas().sort_values(key, ignore_index=True) for d in (got, want))
    assert len(want) > 20
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=False, rtol=1e-9)


@pytest.mark.parametrize("step,schema", [(MeanReversionStrategy(1.7), REVERSION), (PositionedReversion(1.7, entry=1.5), POSITIONED)])
@pytest.mark.parametrize("block_rows", [40, 333, 10**6])
def test_split_walk_equals_the_single_one(spark, hot, step, schema, block_rows):
    df = from_pandas(spark, hot)
    same(run_strategy(df, step, schema, block_rows=block_rows, seconds=3600), walk_strategy(df, step, schema))


def test_a_hot_pair_is_dealt_over_tasks(spark, hot):
    seen = spark.sparkContext.accumulator(0)

    class Counting(PositionedReversion):
        def start(self):
            seen.add(1)
            return super().start()

    found = run_strategy(from_pandas(spark, hot), Counting(1.7), POSITIONED, block_rows=250, seconds=3600)
    assert found.count() > 0
    # Ten blocks of the hot pair and one of the short one begin on their own (and the driver names the first mode).
    assert seen.value >= 11


def test_tracks_merge_when_they_agree():
    step = PositionedReversion(1.0, window=5, entry=1.0, exit_=0.5, min_obs=2)
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=60, freq="min"), "y": np.sin(np.arange(60)), "x": 0.0})
    tracks = Tracks(step, step.start(), None)
    assert len(tracks.live) == 3
    for row in rows.itertuples(index=False):
        tracks.advance(row)
    assert len(tracks.live) == 1 and len(set(tracks.exits())) == 1
    for k, mode in enumerate(step.modes):
        state, want = step.with_mode(step.start(), mode), []
        for row in rows.itertuples(index=False):
            state, emitted = step.advance(state, row)
            want += [emitted] if emitted else []
        assert [e for modes, e in tracks.out if k in modes] == want


def test_steps_without_bounded_memory_walk_a_key_at_once(spark, hot):
    assert PriceBoard().memory is None
    got = run_strategy(from_pandas(spark, hot), PriceBoard(), SNAPSHOT)
    assert got.count() == len(hot)


def test_board_ledger_fills_at_the_standing_price(spark):
    base = pd.Timestamp("2024-01-01")
    rng = np.random.default_rng(6)
    a = pd.DataFrame({"symbol": "A", "ts": base + pd.to_timedelta(np.arange(0, 4000, 2), unit="min"), "close": 100 + rng.normal(size=2000).cumsum()})
    b = pd.DataFrame({"symbol": "B", "ts": base + pd.to_timedelta(np.arange(501, 4000, 3), unit="min")})
    b["close"] = 50 + rng.normal(size=len(b)).cumsum()
    closes = from_pandas(spark, pd.concat([a, b], ignore_index=True))
    chosen = spark.createDataFrame([("A", "B")], "leg_1 string, leg_2 string")
    step = PositionedReversion(1.0)
    got = research.board_backtest(closes, chosen, step, POSITIONED, 10, 12, seconds=86_400).toPandas()
    # The plain loop over the filled board.
    wide = pd.concat([a, b]).pivot(index="ts", columns="symbol", values="close").ffill().dropna()
    state, want = step.start(), []
    for ts, row in wide.iterrows():
        state, e = step.advance(state, pd.Series({"ts": ts, "y": row["A"], "x": row["B"]}))
        if e is None:
            continue
        buys = e[1] == "ENTRY_LONG" or (e[1] == "EXIT_ALL" and e[2] < 0)
        want.append((ts, e[1], "A", "BUY" if buys else "SELL", 10.0, row["A"]))
        want.append((ts, e[1], "B", "SELL" if buys else "BUY", 12.0, row["B"]))
    assert len(want) > 50
    rows = sorted(got[["time", "signal", "asset", "action", "qty", "price"]].itertuples(index=False, name=None))
    assert rows == sorted(want)


def test_orders_before_the_first_price_are_not_filled(spark):
    prices = from_pandas(spark, pd.DataFrame({"symbol": "A", "ts": [pd.Timestamp("2024-01-02")], "close": [5.0]}))
    asked = pd.DataFrame({"key": ["A", "A", "B"], "ts": pd.to_datetime(["2024-01-01", "2024-03-01", "2024-03-01"]), "qty": [1.0, 2.0, 3.0]})
    got = signals.standing_ledger(from_pandas(spark, asked), prices).collect()
    assert [(r["key"], r["qty"], r["price"]) for r in got] == [("A", 2.0, 5.0)]


def test_gate_stands_below_the_pair_join(spark, tmp_path):
    rng = np.random.default_rng(9)
    stamps = pd.date_range("2024-01-01", periods=50, freq="h")
    common = rng.normal(size=50).cumsum()
    names = [f"S{i}" for i in range(8)]
    long = pd.concat([pd.DataFrame({"symbol": s, "ts": stamps, "close": 50 + common * (i < 3) + rng.normal(size=50) * (0.1 if i < 3 else 5)}) for i, s in enumerate(names)])
    closes = from_pandas(spark, long.reset_index(drop=True))
    lines = pairs.hedge_stats(pairs.pair_moments(closes)).where("corr >= 0.8")
    lines.write.parquet(str(tmp_path / "lines"))
    kept = spark.read.parquet(str(tmp_path / "lines"))
    rows = pairs.pair_bars(closes, kept.select(*KEY))
    assert 0 < kept.count() < 28
    assert rows.count() == 50 * kept.count()
    assert rows.select(*KEY).distinct().count() == kept.count() and rows.join(kept, KEY, "left_anti").isEmpty()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_derived_tables_follow_their_input(spark, tmp_path):
    from tidepair.suite import data

    folder = str(tmp_path)
    spark.range(10).write.parquet(f"{folder}/events.parquet")
    build = lambda: spark.read.parquet(f"{folder}/events.parquet").selectExpr("sum(id) as s")
    assert data._stored(spark, folder, "probe", build).first()["s"] == 45
    first = dict(data._tables)
    assert data._stored(spark, folder, "probe", build).first()["s"] == 45 and data._tables == first
    spark.range(100).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    assert data._stored(spark, folder, "probe", build).first()["s"] == 4950
    # A changed neighbour that the table does not come from changes nothing.
    spark.range(3).write.parquet(f"{folder}/lineitem.parquet")
    before = len(data._tables)
    assert data._stored(spark, folder, "probe", build).first()["s"] == 4950 and len(data._tables) == before


def test_wide_table_holds_one_column_a_symbol(spark):
    long = pd.DataFrame({"symbol": ["A", "B", "A"], "ts": pd.to_datetime(["2024-01-01", "2024-01-01", "2024-01-02"]), "close": [1.0, 2.0, 3.0]})
    got = align.to_wide(from_pandas(spark, long), ["A", "B"]).orderBy("ts").collect()
    assert [(r["A"], r["B"]) for r in got] == [(1.0, 2.0), (3.0, None)]
