"""Pair moments, half-life and unit-root tests against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tests.helpers import from_pandas, walk_pairs
from tidepair.functions import unit_root
from tidepair.operators import pairs, stats
from tidepair.plans import discovery


@pytest.fixture(scope="module")
def universe():
    rng = np.random.default_rng(3)
    stamps = pd.date_range("2024-01-01", periods=300, freq="h")
    parts = []
    for i in range(9):
        kept = np.sort(rng.choice(300, 300 if i == 0 else rng.integers(40, 290), replace=False))
        parts.append(
            pd.DataFrame({"symbol": f"S{i}", "ts": stamps[kept], "close": 100 + np.cumsum(rng.normal(size=300))[kept]})
        )
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("n_blocks,n_slabs", [(None, None), (1, 4), (3, 1), (5, 7)])
def test_pair_moments(spark, universe, n_blocks, n_slabs):
    moments = pairs.pair_moments(from_pandas(spark, universe), n_blocks=n_blocks, n_slabs=n_slabs)
    got = pairs.hedge_stats(moments).toPandas().set_index(["leg_1", "leg_2"])
    wide = universe.pivot(index="ts", columns="symbol", values="close")
    names = sorted(wide.columns)
    seen = 0
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = wide[[a, b]].dropna()
            if both.empty:
                continue
            seen += 1
            row = got.loc[(a, b)]
            slope, alpha = np.polyfit(both[b], both[a], 1)
            resid = both[a] - slope * both[b] - alpha
            assert row["n"] == len(both)
            assert row["corr"] == pytest.approx(both[a].corr(both[b]), abs=1e-9)
            assert row["beta"] == pytest.approx(slope, abs=1e-9)
            assert row["alpha"] == pytest.approx(alpha, abs=1e-6)
            assert row["vol_pct"] == pytest.approx(resid.std() / both[a].mean(), abs=1e-9)
            assert row["beta_origin"] == pytest.approx((both[a] @ both[b]) / (both[b] @ both[b]), abs=1e-9)
    assert len(got) == seen


def test_min_rows_and_rank(spark, universe):
    df = from_pandas(spark, universe)
    kept = pairs.list_pairs(df, min_rows=150).toPandas()
    assert (kept["n"] >= 150).all()
    symbols = sorted(universe["symbol"].unique())
    rank = spark.createDataFrame([(s, -i) for i, s in enumerate(symbols)], "symbol string, rank int")
    turned = pairs.orient(pairs.pair_moments(df), rank).toPandas()
    assert (turned["leg_1"] > turned["leg_2"]).all()


def test_exchanged_rows_do_not_follow_slabs(spark, universe):
    """What is exchanged is matrix rows of strips: one a series and strip, not one a pair and slab."""
    from tidepair.operators import blocks

    df = from_pandas(spark, universe).withColumnRenamed("close", "v")
    series, n_blocks = pairs._numbered_series(df, 1, 1, None)
    rows = df.join(series, "symbol").select("_home", "_at", F.unix_micros("ts").alias("ts_us"), "v")
    n = universe["symbol"].nunique()
    for n_slabs in (1, 8, 64, 240):
        strips = -(-n_slabs // blocks.SLABS_PER_STRIP)
        made = blocks.matrix_rows(rows, n_blocks, F.lit(n_slabs))
        assert made.count() <= strips * n
        assert blocks.added(made).count() <= n


def test_rank_decides_legs_in_the_moments(spark, universe):
    df = from_pandas(spark, universe)
    symbols = sorted(universe["symbol"].unique())
    rank = spark.createDataFrame([(s, (i * 5) % 9) for i, s in enumerate(symbols[1:], 1)], "symbol string, rank int")
    got = pairs.pair_moments(df, rank=rank, n_blocks=3).orderBy("leg_1", "leg_2").collect()
    place = {r["symbol"]: r["rank"] for r in rank.collect()}
    # A symbol that the catalogue lacks forms no pair.
    assert {s for r in got for s in (r["leg_1"], r["leg_2"])} == set(symbols[1:])
    assert all(place[r["leg_1"]] < place[r["leg_2"]] for r in got)
    want = pairs.orient(pairs.pair_moments(df), rank).orderBy("leg_1", "leg_2").collect()
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3]
        np.testing.assert_allclose(a[3:], b[3:], rtol=1e-9)


def test_moments_of_wide_universe_cross_blocks(spark):
    """More series than one block holds, over several blocks and strips, against numpy."""
    rng = np.random.default_rng(11)
    stamps = pd.date_range("2024-01-01", periods=40, freq="h")
    values = rng.normal(size=(40, 60)).cumsum(axis=0)
    wide = pd.DataFrame(values, index=stamps, columns=[f"S{i:02d}" for i in range(60)])
    long = wide.stack().rename("close").reset_index().set_axis(["ts", "symbol", "close"], axis=1)
    got = pairs.hedge_stats(pairs.pair_moments(from_pandas(spark, long), n_blocks=4, n_slabs=20)).toPandas()
    assert len(got) == 60 * 59 // 2 and (got["n"] == 40).all() and (got["leg_1"] < got["leg_2"]).all()
    corr = wide.corr()
    want = [corr.loc[a, b] for a, b in zip(got["leg_1"], got["leg_2"])]
    np.testing.assert_allclose(got["corr"], want, atol=1e-9)


def test_pair_bars_inner(spark, universe):
    df = from_pandas(spark, universe)
    one = spark.createDataFrame([("S1", "S2")], "leg_1 string, leg_2 string")
    got = pairs.pair_bars(df, one).toPandas().sort_values("ts", ignore_index=True)
    wide = universe.pivot(index="ts", columns="symbol", values="close")[["S1", "S2"]].dropna()
    assert list(got["y"]) == list(wide["S1"]) and list(got["x"]) == list(wide["S2"])


def numbered(spark, values):
    n = len(values)
    pdf = walk_pairs(n).assign(spread=values, n=n)[["leg_1", "leg_2", "ts", "pos", "spread", "n"]]
    return from_pandas(spark, pdf)


def test_half_life_cases(spark):
    got = stats.half_life(numbered(spark, [4.0, 2.0, 1.0, 0.5])).first()
    assert got["half_life"] == pytest.approx(np.log(2) / 0.5)
    assert stats.half_life(numbered(spark, [1.0, 2.0, 4.0, 8.0])).first()["half_life"] == float("inf")


@pytest.mark.parametrize("block_rows", [10, 100_000])
def test_half_life_matches_regression(spark, block_rows):
    rng = np.random.default_rng(4)
    v = np.zeros(300)
    for i in range(1, 300):
        v[i] = 0.8 * v[i - 1] + rng.normal()
    lag, ret = v[:-1], np.diff(v)
    lag, ret = np.append(lag, lag[0]), np.append(ret, ret[0])
    slope = np.polyfit(lag, ret, 1)[0]
    got = stats.half_life(numbered(spark, v), block_rows=block_rows).first()["half_life"]
    assert got == pytest.approx(-np.log(2) / slope, rel=1e-9)


def brute_adf(v, constant, lags=None):
    """Statistic by ordinary least squares on explicit regressors."""
    n = len(v)
    d = np.diff(v)
    top = unit_root.max_lag(n, constant) if lags is None else lags

    def fit(lag, first):
        rows = range(first, n)
        x = [[v[t - 1]] + [d[t - 1 - k] for k in range(1, lag + 1)] + ([1.0] if constant else []) for t in rows]
        y = np.array([d[t - 1] for t in rows])
        x = np.array(x)
        coef, *_ = np.linalg.lstsq(x, y, rcond=None)
        ssr = ((y - x @ coef) ** 2).sum()
        return x, coef, ssr, len(y)

    if lags is None:
        scores = []
        for lag in range(top + 1):
            x, _, ssr, m = fit(lag, top + 1)
            llf = -m / 2 * (np.log(2 * np.pi) + np.log(ssr / m) + 1)
            scores.append(-2 * llf + 2 * x.shape[1])
        lag = int(np.argmin(scores))
    else:
        lag = lags
    x, coef, ssr, m = fit(lag, lag + 1)
    error = np.sqrt(ssr / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    return coef[0] / error, lag, m


@pytest.mark.parametrize("constant", [True, False])
@pytest.mark.parametrize("n,rho", [(60, 0.5), (700, 1.0), (4000, 0.97)])
def test_adf_matches_least_squares(spark, constant, n, rho):
    rng = np.random.default_rng(n)
    v, e = np.zeros(n), rng.normal(size=n)
    for i in range(2, n):
        v[i] = rho * v[i - 1] + 0.3 * (v[i - 1] - v[i - 2]) + e[i]
    got = stats.adf(numbered(spark, v), constant=constant, block_rows=1400).first()
    stat, lag, m = brute_adf(v, constant)
    assert got["used_lag"] == lag and got["n_obs"] == m
    assert got["adf_stat"] == pytest.approx(stat, rel=1e-7)
    assert got["p_value"] == pytest.approx(unit_root.p_value(stat), abs=1e-9)


def test_adf_fixed_lag_and_closed_form(spark):
    rng = np.random.default_rng(9)
    v = np.cumsum(rng.normal(size=400))
    for lags in (0, 3):
        stat, _, _ = brute_adf(v, True, lags)
        assert stats.adf(numbered(spark, v), lags=lags).first()["adf_stat"] == pytest.approx(stat, rel=1e-8)
    stat, _, m = brute_adf(v, True, 0)
    closed = stats.dickey_fuller_lag0(numbered(spark, v), block_rows=37).first()
    assert closed["adf_stat"] == pytest.approx(stat, rel=1e-8) and closed["n_obs"] == m


def test_adf_of_many_short_series_without_a_group_each(spark):
    """Series of one block are solved next to each other where they lie; those without a verdict leave no trace."""
    rng = np.random.default_rng(5)
    series = {f"S{i:02d}": np.cumsum(rng.normal(size=n)) for i, n in enumerate([3, 40, 41, 2, 90, 200, 333, 1])}
    rows = [(k, "B", float(x), i + 1, len(v)) for k, v in series.items() for i, x in enumerate(v)]
    tested = stats.adf(spark.createDataFrame(rows, "leg_1 string, leg_2 string, spread double, pos long, n long"))
    assert "FlatMapGroupsInPandas" not in tested._jdf.queryExecution().toString()
    got = {r["leg_1"]: r for r in tested.collect()}
    assert set(got) == {k for k, v in series.items() if len(v) >= 40}
    for k, r in got.items():
        stat, lag, m = brute_adf(series[k], True)
        assert (r["leg_2"], r["used_lag"], r["n_obs"]) == ("B", lag, m) and r["adf_stat"] == pytest.approx(stat, rel=1e-8)


def test_adf_too_short_gives_no_row(spark):
    assert stats.adf(numbered(spark, [1.0, 2.0, 1.5])).count() == 0


def test_p_values_at_published_points():
    for n_vars, points in ((1, [(-3.43, 0.010), (-2.86, 0.050), (-2.57, 0.099)]), (2, [(-3.90, 0.010), (-3.34, 0.050), (-3.04, 0.101)])):
        for stat, p in points:
            assert unit_root.p_value(stat, n_vars) == pytest.approx(p, abs=6e-4)
    assert unit_root.p_value(-30) == 0.0 and unit_root.p_value(5) == 1.0


def test_pair_scan_finds_the_bound_pair(spark):
    n = 1500
    bound = walk_pairs(n, seed=2)
    rng = np.random.default_rng(11)
    free = 1000 + np.cumsum(rng.normal(size=n))
    series = {"A": bound["y"], "B": bound["x"], "C": free}
    long = pd.concat([pd.DataFrame({"symbol": s, "ts": bound["ts"], "close": v}) for s, v in series.items()])
    found = discovery.pair_scan(from_pandas(spark, long), half_life_range=(0, 1000)).toPandas()
    assert list(zip(found["Leg_1"], found["Leg_2"])) == [("A", "B")]
    row = found.iloc[0]
    slope, alpha = np.polyfit(bound["x"], bound["y"], 1)
    resid = (bound["y"] - slope * bound["x"] - alpha).to_numpy()
    assert row["Hedge_Ratio"] == round(slope, 3)
    stat, _, _ = brute_adf(resid, False)
    assert row["Coint_Pvalue"] == pytest.approx(unit_root.p_value(stat, 2), abs=1e-5)
    both = discovery.stationary_scan(from_pandas(spark, long)).toPandas().set_index("Pair")
    assert len(both) == 6 and both.loc["A-B", "Stationary"] and both.loc["B-A", "Stationary"]
    wild = discovery.vol_scan(from_pandas(spark, long)).toPandas()
    assert wild["Vol_Pct"].iat[0] == pytest.approx(resid.std(ddof=1) / bound["y"].mean(), rel=1e-6)


def test_perfect_fit_is_cointegrated(spark):
    pdf = walk_pairs(200)
    long = pd.concat(
        [
            pd.DataFrame({"symbol": "A", "ts": pdf["ts"], "close": 2 * pdf["x"] + 1}),
            pd.DataFrame({"symbol": "B", "ts": pdf["ts"], "close": pdf["x"]}),
        ]
    )
    df = from_pandas(spark, long)
    lines, rows = discovery.candidates(df, F.col("n") > 0, 1, 86_400)
    got = stats.coint(rows, lines).first()
    assert got["coint_stat"] == float("-inf") and got["p_value"] == 0.0
