"""Gated pairs out of tiles against pair moments, gate and pair join over everything."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tests.helpers import frame, from_pandas
from tidepair.functions import panel, unit_root
from tidepair.operators import pairs, stats, tiles
from tidepair.operators.pairs import PAIR
from tidepair.plans import discovery

GATE = (60, 0.3)


@pytest.fixture(scope="module")
def universe():
    rng = np.random.default_rng(5)
    stamps = pd.date_range("2024-01-01", periods=200, freq="W")
    common = np.cumsum(rng.normal(size=200))
    parts = []
    for i in range(25):
        kept = np.sort(rng.choice(200, rng.integers(40, 200), replace=False))
        close = 1e4 + rng.normal() * common + np.cumsum(rng.normal(size=200))
        parts.append(pd.DataFrame({"symbol": f"S{i}", "ts": stamps[kept], "close": close[kept]}))
    flat = pd.DataFrame({"symbol": "flat", "ts": stamps, "close": 7.0})
    return pd.concat([*parts, flat], ignore_index=True)


def _lines(df):
    found = pairs.hedge_stats(pairs.pair_moments(df))
    return found.where((F.col("n") >= GATE[0]) & (F.col("corr") >= GATE[1]))


@pytest.mark.parametrize("cells", [tiles.CELLS, 200 * 7, 1])
def test_gated_moments(spark, universe, cells, monkeypatch):
    monkeypatch.setattr(tiles, "PAIRS_AT_ONCE", 20)
    df = from_pandas(spark, universe)
    got = pairs.hedge_stats(tiles.gated_moments(df, min_rows=GATE[0], min_corr=GATE[1], cells=cells)).toPandas()
    want = _lines(df).toPandas()
    assert 20 < len(want) < 25 * 24 / 2
    pd.testing.assert_frame_equal(got.sort_values(PAIR, ignore_index=True), want.sort_values(PAIR, ignore_index=True), rtol=1e-9)


@pytest.mark.parametrize("cells", [tiles.CELLS, 200 * 7, 1])
def test_blocks_without_series_add_no_pairs(spark, universe, cells):
    df = from_pandas(spark, universe)
    got = tiles.gated_moments(df, min_rows=GATE[0], min_corr=-1.0, cells=cells)
    want = pairs.pair_moments(df, min_rows=GATE[0]).where("cyy > 0 and cxx > 0")
    assert sorted(got.select(*PAIR, "n").collect()) == sorted(want.select(*PAIR, "n").collect())


@pytest.mark.parametrize("cells", [tiles.CELLS, 200 * 7])
def test_gated_rows(spark, universe, cells):
    df = from_pandas(spark, universe)
    got = tiles.gated_rows(df, min_rows=GATE[0], min_corr=GATE[1], cells=cells).toPandas()
    want = pairs.pair_bars(df, _lines(df).select(*PAIR, "alpha", "beta")).toPandas().sort_values([*PAIR, "ts"], ignore_index=True)
    want["pos"] = want.groupby(PAIR).cumcount() + 1
    want["spread"] = want["y"] - want["alpha"] - want["beta"] * want["x"]
    got = got.sort_values([*PAIR, "ts"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want[got.columns], rtol=1e-9, atol=1e-7)


def test_copies_of_a_timestamp_are_an_error(spark, universe):
    df = from_pandas(spark, pd.concat([universe, universe.head(1)]))
    with pytest.raises(Exception, match="several rows at one timestamp"):
        tiles.gated_moments(df).collect()


def test_no_series(spark, universe):
    df = from_pandas(spark, universe).where("symbol = 'none'")
    assert tiles.gated_moments(df).count() == 0 and tiles.gated_rows(df).count() == 0


def test_pairs_are_not_exchanged(spark):
    """Behind the tiles nothing is joined or exchanged, and a series is one record a tile."""
    from tidepair.suite import wide

    for query in (wide.wide_pair_corr, wide.wide_pair_rows):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan[: plan.index("MapInArrow")]
        assert "Window" not in plan and "Join" not in plan


def test_exchanged_records_do_not_follow_rows(spark, universe):
    df = from_pandas(spark, universe)
    series = universe["symbol"].nunique()
    blocks = -(-series // 7)
    assert tiles._cells(df, "close", 1, 200 * 7).count() <= series * (blocks + 2)


TESTS = ["n", "corr", "beta", "half_life", "coint_stat", "p_value", "used_lag"]


def _tested(df, rank=None):
    gate = (F.col("n") >= GATE[0]) & (F.col("corr") >= GATE[1])
    lines, numbered = discovery.candidates(df, gate, GATE[0], 86_400 * 365, rank)
    return stats.coint(numbered, lines).join(stats.half_life(numbered), PAIR, "left").select(*PAIR, *TESTS).toPandas().sort_values(PAIR, ignore_index=True)


@pytest.mark.parametrize("cells", [tiles.CELLS, 200 * 7, 1])
def test_gated_tests(spark, universe, cells, monkeypatch):
    monkeypatch.setattr(tiles, "TESTED_AT_ONCE", 50)
    df = from_pandas(spark, universe)
    found = tiles.gated_tests(df, min_rows=GATE[0], min_corr=GATE[1], cells=cells)
    got = pairs.hedge_stats(found).select(*PAIR, *TESTS).toPandas().sort_values(PAIR, ignore_index=True)
    pd.testing.assert_frame_equal(got, _tested(df), rtol=1e-7, check_dtype=False)


def test_gated_tests_within_limits(spark, universe):
    df = from_pandas(spark, universe)
    want = _tested(df)
    low, high, max_p = *want["half_life"].quantile([0.2, 0.8]), want["p_value"].quantile(0.6)
    want = want[(want["half_life"] > low) & (want["half_life"] < high) & (want["p_value"] < max_p)]
    got = tiles.gated_tests(df, min_rows=GATE[0], min_corr=GATE[1], max_p=max_p, half_life_range=(low, high)).select(*PAIR).toPandas()
    assert 5 < len(want) == len(got) and set(map(tuple, got.to_numpy())) == set(map(tuple, want[PAIR].to_numpy()))


def test_gated_tests_take_legs_by_rank(spark, universe):
    df = from_pandas(spark, universe)
    rows = [(f"S{i}", None if i == 3 else float("nan") if i == 7 else float(i % 4)) for i in range(24)] + [(None, 1.0)]
    rank = frame(spark, rows, "symbol string, rank double")
    found = tiles.gated_tests(df, min_rows=GATE[0], min_corr=GATE[1], rank=rank, cells=200 * 7)
    got = pairs.hedge_stats(found).select(*PAIR, *TESTS).toPandas().sort_values(PAIR, ignore_index=True)
    want = _tested(df, rank)
    assert (want["leg_1"] > want["leg_2"]).any() and "S24" not in {*want["leg_1"], *want["leg_2"]}
    pd.testing.assert_frame_equal(got, want, rtol=1e-7, check_dtype=False)


def test_a_wide_scan_writes_no_pair_rows(spark, universe, monkeypatch):
    """What is written between the steps is a row a tested pair; a rank that names a symbol twice goes the long way."""
    from tidepair.suite import wide

    written, kept = {}, discovery.stage

    def noted(df, name):
        out = kept(df, name)
        written[name] = set(out.columns)
        return out

    monkeypatch.setattr(discovery, "stage", noted)
    for query in (wide.wide_pair_scan, wide.wide_scan_export, wide.wide_catalogue_scan):
        written.clear()
        query(spark, "/root/testdata/sf0.001").collect()
        assert not [name for name, columns in written.items() if "leg_1" in columns and {"ts", "pos"} & columns]
    df, limits = from_pandas(spark, universe), dict(min_rows=60, min_corr=0.3, max_p=0.5, half_life_range=(1, 100))
    rank = frame(spark, [(f"S{i}", float(i % 4)) for i in range(25)] + [("S1", 9.0)], "symbol string, rank double")
    for by in (None, rank):
        one, two = (discovery.pair_scan(df, **limits, rank=by, wide=wide_).collect() for wide_ in (True, False))
        # The order of equal p-values is that of the legs; copies have none.
        assert one and sorted(one) == sorted(two)


def _series(values):
    return np.array([[*v, *[0.0] * (120 - len(v))] for v in values]), np.array([len(v) for v in values])


def test_panel_against_single_series():
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(size=120))
    values = [walk, walk[:61], rng.normal(size=90), walk[:12], walk[:3], walk[:1], np.full(70, 2.0), np.zeros(40), [(-1.0) ** k for k in range(80)], np.linspace(1, 2, 100), 1e6 + walk]
    rows, n = _series(values)
    stat, lag = panel.level_tests(rows, n)
    p = panel.p_values(stat, 2)
    for k, v in enumerate(values):
        v = np.asarray(v)
        top = unit_root.max_lag(len(v), False)
        if top < 0 or len(v) <= top + 3:
            assert np.isnan(stat[k]) and lag[k] == -1
            continue
        want, used = panel._single(v, top)
        assert (lag[k], stat[k]) == (used, pytest.approx(want, rel=1e-7, nan_ok=True))
        assert p[k] == pytest.approx(unit_root.p_value(want, 2), nan_ok=True)


def test_panel_half_lives_against_points():
    rng = np.random.default_rng(10)
    values = [np.cumsum(rng.normal(size=m)) for m in (120, 60, 5, 2)] + [np.full(30, 4.0), [3.0], np.arange(50.0) ** 2]
    slope, bars = panel.half_lives(*_series(values))
    for k, v in enumerate(values):
        v = np.asarray(v)
        before, change = np.r_[v[:1], v[:-1]], np.r_[np.diff(v)[:1], np.diff(v)]
        if len(v) < 3 or np.ptp(v) == 0:
            assert np.isnan(bars[k])
            continue
        want = np.polyfit(before, change, 1)[0]
        assert slope[k] == pytest.approx(want, rel=1e-9)
        assert bars[k] == (np.inf if want >= 0 else pytest.approx(-np.log(2) / want, rel=1e-9))
