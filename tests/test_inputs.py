"""Inputs that the suite's tables never hold: landed vwap, NaN, copies, null keys, long lags."""

import json

import numpy as np
import pytest

from tidepair.operators import align, clean, ordered, pairs, stats
from tidepair.sources import bars as store


def landed(spark, tmp_path, records, name):
    path = tmp_path / name
    path.mkdir()
    (path / "part.json").write_text("\n".join(json.dumps(r) for r in records))
    raw = store.read_vendor_json(spark, str(path))
    timed = raw.withColumn("ts", clean.epoch_ms("timestamp")).withColumnRenamed("ticker", "symbol")
    return [r.asDict() for r in clean.normalize_bars(timed).orderBy("ts").collect()]


def test_vendor_vwap_is_kept(spark, tmp_path):
    base = {"ticker": "A", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10.0}
    with_vw = landed(spark, tmp_path, [{**base, "timestamp": 0, "vw": 1.05}, {**base, "timestamp": 1000, "vw": None}], "short")
    assert [r["vwap"] for r in with_vw] == [1.05, None]
    without = landed(spark, tmp_path, [{**base, "timestamp": 0}], "none")
    assert without[0]["vwap"] == 0.0 and without[0]["close"] == 1.5
    long_names = {"ticker": "A", "timestamp": 0, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 9.0, "vwap": 1.25}
    assert landed(spark, tmp_path, [long_names], "long")[0]["vwap"] == 1.25


def closes(spark, series):
    rows = [(s, t * 60, float(v)) for s, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, t long, close double").selectExpr("symbol", "timestamp_seconds(t) AS ts", "close")


def test_one_nan_costs_one_row(spark):
    rng = np.random.default_rng(0)
    a = np.cumsum(rng.normal(size=50)) + 100
    b = a * 2 + rng.normal(size=50)
    b[7] = np.nan
    df = closes(spark, {"A": a, "B": b})
    row = pairs.hedge_stats(pairs.pair_moments(df)).first()
    ok = ~np.isnan(b)
    assert row.n == 49 and row["corr"] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1])
    chosen = spark.createDataFrame([("A", "B")], "leg_1 string, leg_2 string")
    assert pairs.pair_bars(df, chosen).count() == 49
    assert align.align_inner_all(df).count() == 98
    assert align.align_outer_ffill(df).where("isnan(close)").count() == 0
    path_free = clean.nan_to_null(df, ["close"])
    assert path_free.where("close IS NULL").count() == 1


def test_copies_are_no_second_symbol(spark):
    df = closes(spark, {"A": [1, 2], "B": [1]})
    doubled = df.unionByName(df.where("symbol = 'A' AND close = 2"))
    assert {str(r.ts)[-5:] for r in align.align_inner_all(doubled).collect()} == {"00:00"}
    with pytest.raises(Exception, match="several rows at one timestamp"):
        pairs.pair_moments(doubled).collect()


def test_null_key_is_an_error(spark):
    rows = [(None, day * 86400) for day in range(4)] + [("A", 0)]
    df = spark.createDataFrame(rows, "symbol string, t long").selectExpr("symbol", "timestamp_seconds(t) AS ts")
    with pytest.raises(Exception, match="null in key column symbol"):
        ordered.with_position(df, ["symbol"], ["ts"], "pos", 2 * 86400).collect()
    good = ordered.with_position(df.where("symbol IS NOT NULL"), ["symbol"], ["ts"], "pos", 2 * 86400).collect()
    assert [r.pos for r in good] == [1]


@pytest.mark.parametrize("block_rows", [2000, 100_000])
def test_lags_beyond_the_default_overlap(spark, block_rows):
    n, lags = 6000, 800
    x = np.cumsum(np.random.default_rng(3).normal(size=n))
    d = np.diff(x)
    at = np.arange(lags + 1, n)
    design = np.column_stack([np.ones(len(at)), x[at - 1]] + [d[at - 1 - k] for k in range(1, lags + 1)])
    coef, *_ = np.linalg.lstsq(design, d[at - 1], rcond=None)
    rest = d[at - 1] - design @ coef
    variance = rest @ rest / (len(at) - design.shape[1]) * np.linalg.inv(design.T @ design)[1, 1]
    df = spark.createDataFrame([("A", "B", float(v), i + 1, n) for i, v in enumerate(x)], "leg_1 string, leg_2 string, spread double, pos long, n long")
    got = stats.adf(df, lags=lags, block_rows=block_rows).first()
    assert got.used_lag == lags and got.adf_stat == pytest.approx(coef[1] / np.sqrt(variance), rel=1e-6)


def test_crowded_chunk_of_probes_is_cut(spark):
    rng = np.random.default_rng(8)
    bars = closes(spark, {"A": rng.normal(size=40), "B": rng.normal(size=3)})
    probes = spark.range(3000).selectExpr("IF(id % 50 = 0, 'B', 'A') AS symbol", "timestamp_micros(id * 793123) AS ts")
    key = lambda df: sorted((r.symbol, r.ts, r.close) for r in df.collect())
    whole = key(align.asof_join(bars, probes, max_rows=None))
    assert len(whole) == 3000 and key(align.asof_join(bars, probes, max_rows=200)) == whole
    last = {(r.symbol, r.ts): r.close for r in bars.collect()}
    for symbol, ts, close in whole[::97]:
        seen = [(t, c) for (s, t), c in last.items() if s == symbol and t <= ts]
        assert close == (max(seen)[1] if seen else None)


@pytest.mark.parametrize("n", [1, 7, 100])
def test_tails_read_only_the_chunks_they_need(spark, n):
    from tidepair.operators import windows

    df = closes(spark, {"A": range(60), "B": range(5)})
    for rows, pick in ((windows.tail_n(df, n, seconds=600), lambda v: v[-n:]), (windows.head_n(df, n, seconds=600), lambda v: v[:n])):
        got = {}
        for r in rows.collect():
            got.setdefault(r.symbol, []).append(r.close)
        assert {s: sorted(v) for s, v in got.items()} == {"A": pick(list(range(60))), "B": pick(list(range(5)))}
