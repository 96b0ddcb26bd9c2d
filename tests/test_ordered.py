"""Two-level ordered operators against plain pandas, with one hot key and tiny chunks."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tests.helpers import from_pandas
from tidepair.operators import ordered


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    parts = []
    for symbol, n in (("hot", 400), ("thin", 30), ("one", 1)):
        minutes = np.sort(rng.choice(6000, n, replace=False))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, unit="min"),
                    "v": rng.integers(-50, 50, n).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def collect(df):
    out = df.toPandas()
    return out.sort_values(["symbol", "ts"], ignore_index=True)


@pytest.mark.parametrize("seconds", [600, 7200, 10**7])
def test_neighbours_and_sums(spark, series, seconds):
    df = from_pandas(spark, series)
    got = collect(
        ordered.with_neighbour(df, ["symbol"], ["ts"], {"before": "v"}, seconds)
    )
    by = series.groupby("symbol")["v"]
    want = series.assign(before=by.shift(1)).sort_values(["symbol", "ts"], ignore_index=True)
    pd.testing.assert_series_equal(got["before"], want["before"])
    after = collect(ordered.with_neighbour(df, ["symbol"], ["ts"], {"after": "v"}, seconds, following=True))
    want = series.assign(after=by.shift(-1)).sort_values(["symbol", "ts"], ignore_index=True)
    pd.testing.assert_series_equal(after["after"], want["after"])
    sums = collect(ordered.with_running_sum(df, ["symbol"], ["ts"], {"total": "v"}, seconds))
    want = series.assign(total=by.cumsum()).sort_values(["symbol", "ts"], ignore_index=True)
    pd.testing.assert_series_equal(sums["total"], want["total"])
    numbered = collect(ordered.with_position(df, ["symbol"], ["ts"], "pos", seconds))
    want = series.assign(pos=by.cumcount() + 1).sort_values(["symbol", "ts"], ignore_index=True)
    pd.testing.assert_series_equal(numbered["pos"], want["pos"], check_dtype=False)


@pytest.mark.parametrize("seconds", [600, 10**7])
def test_last_known(spark, series, seconds):
    holes = series.assign(v=series["v"].where(series["v"] > 20))
    df = from_pandas(spark, holes).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = collect(ordered.with_last_known(df, ["symbol"], ["ts"], {"v": "v"}, seconds))
    want = holes.assign(v=holes.groupby("symbol")["v"].ffill()).sort_values(["symbol", "ts"], ignore_index=True)
    pd.testing.assert_series_equal(got["v"], want["v"])


@pytest.mark.parametrize("block_rows", [7, 50, 100_000])
def test_rolling(spark, series, block_rows):
    pos = series.assign(pos=series.groupby("symbol").cumcount() + 1)
    got = collect(
        ordered.with_rolling(
            from_pandas(spark, pos), ["symbol"], "pos", 7, {"m": lambda w: F.sum("v").over(w)}, block_rows
        )
    )
    rolled = series.groupby("symbol")["v"].rolling(7, min_periods=1).sum().reset_index(level=0, drop=True)
    want = series.assign(m=rolled).sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(series)
    pd.testing.assert_series_equal(got["m"], want["m"])


@pytest.mark.parametrize("seconds", [600, 10**7])
def test_drawdown(spark, series, seconds):
    got = collect(ordered.with_drawdown(from_pandas(spark, series), ["symbol"], ["ts"], "v", seconds))
    equity = series.groupby("symbol")["v"].cumsum()
    peak = equity.groupby(series["symbol"]).cummax()
    want = series.assign(equity=equity, peak=peak, drawdown=equity - peak)
    want = want.sort_values(["symbol", "ts"], ignore_index=True)
    for c in ("equity", "peak", "drawdown"):
        pd.testing.assert_series_equal(got[c], want[c])
    assert (got["drawdown"] <= 0).all()


def test_halo_must_fit_a_block(spark, series):
    with pytest.raises(ValueError):
        ordered.add_blocks(from_pandas(spark, series), "pos", 10, 10)


def test_fitted_chunks_split_a_hot_bucket(spark):
    rng = np.random.default_rng(12)
    # A third of all rows of the symbol fall into one minute; one timestamp is heavily repeated.
    burst = pd.Timestamp("2024-01-03 10:00") + pd.to_timedelta(np.sort(rng.integers(0, 60_000_000, 3000)), unit="us")
    wide = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 9 * 86_400_000_000, 6000)), unit="us")
    stamps = burst.append(wide).append(pd.DatetimeIndex([burst[0]] * 50)).astype("datetime64[us]")
    pdf = pd.DataFrame({"symbol": "hot", "ts": stamps})
    pdf["v"] = rng.integers(-5, 9, len(pdf))
    pdf = pdf.sort_values("ts", ignore_index=True)
    pdf["id"] = np.arange(len(pdf))
    df = from_pandas(spark, pdf)
    for rows, edges in ((df, None), (df.select("symbol", "ts", "id"), df)):
        before = ordered.with_neighbour(
            rows, ["symbol"], ["ts", "id"], {"b": "id"}, 86_400, max_rows=500, edges=edges
        ).toPandas()
        assert list(before.sort_values("id")["b"].iloc[1:]) == list(range(len(pdf) - 1))
    got = ordered.with_running_sum(df, ["symbol"], ["ts", "id"], {"total": "v"}, 86_400, max_rows=500)
    assert list(got.toPandas().sort_values("id")["total"]) == list(pdf["v"].cumsum())
    chunked = ordered.add_chunk(df, "ts", 86_400)
    cut = ordered.fitted_chunks(chunked, ["symbol"], "ts", 500)
    parts = cut.groupBy(ordered.CHUNK).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("ts").alias("n"))
    parts = parts.toPandas().sort_values(ordered.CHUNK)
    assert parts["n"].sum() == len(pdf) and parts["n"].max() < 500
    assert (parts["hi"].iloc[:-1].to_numpy() < parts["lo"].iloc[1:].to_numpy()).all()


def test_hot_month_is_dealt_over_several_tasks(spark):
    rng = np.random.default_rng(13)
    # One burst of seconds holds most rows of a month; the series has no key at all.
    burst = pd.Timestamp("2024-01-10") + pd.to_timedelta(np.sort(rng.choice(10**7, 4000, replace=False)), unit="us")
    calm = pd.date_range("2024-01-01", periods=200, freq="3h")
    stamps = burst.append(calm).sort_values().astype("datetime64[us]")
    pdf = pd.DataFrame({"ts": stamps, "v": rng.integers(-9, 10, len(stamps)).astype(float)})
    df = from_pandas(spark, pdf)
    cut = ordered.fitted_chunks(ordered.add_chunk(df, "ts", ordered.MONTH), [], "ts", 300)
    sizes = [r["count"] for r in cut.groupBy(ordered.CHUNK).count().collect()]
    assert max(sizes) <= 300 and sum(sizes) == len(pdf)
    got = ordered.with_drawdown(df, [], ["ts"], "v", ordered.MONTH, max_rows=300).toPandas().sort_values("ts")
    equity = pdf["v"].cumsum()
    np.testing.assert_array_equal(got["equity"], equity)
    np.testing.assert_array_equal(got["drawdown"], equity - equity.cummax())


def test_scans_take_crowded_chunks_apart(spark):
    from tests.helpers import walk_pairs
    from tidepair.operators.kalman import KalmanScan
    from tidepair.operators.scan import run_scan

    pdf = walk_pairs(900, step="1s")
    scan = KalmanScan([1e-4], 1e-3, 1.0, True)
    one, many = (run_scan(from_pandas(spark, pdf), scan, ["leg_1", "leg_2"], max_rows=n).toPandas().sort_values("ts") for n in (None, 100))
    np.testing.assert_allclose(many["beta"], one["beta"], rtol=1e-9)
    np.testing.assert_allclose(many["error"], one["error"], rtol=1e-7, atol=1e-9)


def test_no_driver_action_before_the_result(spark, series):
    """Cuts are part of the plan: building it runs no job."""
    df = from_pandas(spark, series)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    try:
        ordered.with_neighbour(df, ["symbol"], ["ts"], {"b": "v"}, 600, max_rows=5)
        ordered.with_drawdown(df, ["symbol"], ["ts"], "v", 600, max_rows=5)
        assert list(tracker.getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
