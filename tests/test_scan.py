"""Chunked scans against plain sequential loops."""

from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pytest

from tests.helpers import from_pandas, walk_pairs
from tidepair.operators.kalman import kalman, kalman_library
from tidepair.operators.positions import positions, trades


def sequential(pdf, q, r, predict_first=True):
    """Matrix form of the filter, one row at a time."""
    mean, cov = np.zeros(2), np.ones((2, 2))
    out = []
    for i, (y, x) in enumerate(zip(pdf["y"], pdf["x"])):
        prior = cov + (q if i or predict_first else 0.0) * np.eye(2)
        h = np.array([1.0, x])
        s = h @ prior @ h + r
        e = y - h @ mean
        gain = prior @ h / s
        mean = mean + gain * e
        cov = prior - np.outer(gain, h @ prior)
        out.append((mean[1], mean[0], e, s))
    return np.array(out)


@pytest.fixture(scope="module")
def pair():
    return walk_pairs(700)


@pytest.mark.parametrize("seconds", [6 * 3600, 86_400, 10**9])
def test_kalman_matches_matrix_form(spark, pair, seconds):
    deltas = [1e-6, 1e-4, 1e-2]
    got = kalman(from_pandas(spark, pair), deltas=deltas, seconds=seconds).toPandas()
    assert len(got) == 3 * len(pair)
    for d in deltas:
        part = got[got["delta"] == d].sort_values("ts")
        want = sequential(pair, d, 1e-3)
        for at, column in enumerate(["beta", "intercept", "error", "s"]):
            np.testing.assert_allclose(part[column], want[:, at], rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose(part["z_score"], want[:, 2] / np.sqrt(want[:, 3]), rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose(part["spread"], pair["y"] - want[:, 0] * pair["x"], rtol=1e-7, atol=1e-6)


def exact_spreads(y, x, q, r, predict_first=True):
    """y less the posterior slope times x, row by row in decimal arithmetic."""
    with localcontext() as context:
        context.prec = 50
        num = lambda v: Decimal(float(v))
        m0, m1, p00, p01, p10, p11 = Decimal(0), Decimal(0), *[Decimal(1)] * 4
        out = []
        for yi, xi in zip(map(num, y), map(num, x)):
            noise = num(q if out or predict_first else 0.0)
            p00, p11 = p00 + noise, p11 + noise
            h0, h1 = p00 + xi * p10, p01 + xi * p11
            k0, k1 = ((p00 + p01 * xi) / (h0 + h1 * xi + num(r)), (p10 + p11 * xi) / (h0 + h1 * xi + num(r)))
            e = yi - m0 - m1 * xi
            m0, m1 = m0 + k0 * e, m1 + k1 * e
            p00, p01, p10, p11 = p00 - k0 * h0, p01 - k0 * h1, p10 - k1 * h0, p11 - k1 * h1
            out.append(float(yi - m1 * xi))
    return np.array(out)


@pytest.mark.parametrize("seconds", [86_400, 10**9])
def test_spread_keeps_its_digits_next_to_large_prices(spark, seconds):
    pdf = walk_pairs(300).assign(x=lambda p: 1e6 + 2e5 * np.arange(300) + 100 * p["x"], y=lambda p: 1.1 * p["x"] + 300 * p["y"])
    rows = from_pandas(spark, pdf)
    # What a rolling z sees are the changes; the library flavour also shows what a chunk is entered with.
    for found, want in [
        (kalman(rows, deltas=[1e-4], seconds=seconds), exact_spreads(pdf["y"], pdf["x"], 1e-4, 1e-3)),
        (kalman_library(rows, deltas=[1e-5], seconds=seconds), exact_spreads(pdf["y"], pdf["x"], 1e-5, 1.0, False)),
    ]:
        got = found.toPandas().sort_values("pos")["spread"].to_numpy()
        assert np.abs(np.diff(got) - np.diff(want))[30:].max() < 1e-3 * np.median(np.abs(np.diff(want)))


@pytest.mark.parametrize("seconds", [6 * 3600, 10**9])
def test_library_flavour(spark, pair, seconds):
    got = kalman_library(from_pandas(spark, pair), seconds=seconds).toPandas().sort_values("ts")
    want = sequential(pair, 1e-5, 1.0, predict_first=False)
    np.testing.assert_allclose(got["beta"], want[:, 0], rtol=1e-8)


def test_first_row_by_hand(spark):
    pdf = pd.DataFrame(
        {"leg_1": "A", "leg_2": "B", "ts": pd.date_range("2024-01-01", periods=3, freq="D"), "pos": [1, 2, 3], "y": [10.0, 11, 12], "x": [4.0, 5, 6]}
    )
    row = kalman(from_pandas(spark, pdf), deltas=[1e-4]).orderBy("ts").first()
    q, x, y = 1e-4, 4.0, 10.0
    s = (1 + q) + 2 * x + (1 + q) * x * x + 1e-3
    assert row["s"] == pytest.approx(s)
    assert row["beta"] == pytest.approx((1 + (1 + q) * x) / s * y)


def test_lanes_equal_the_step_rule():
    """Many chunks of many lengths and noises at once, entered with any state, row by row the same."""
    from tidepair.operators.kalman import KalmanScan, step

    rng = np.random.default_rng(2)
    lengths = [1, 2, 3, 7, 64, 65, 500, 3000]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    n = begins[-1]
    x = 50 + np.cumsum(rng.normal(size=n))
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="min"), "pos": np.arange(n), "y": 3 + 1.5 * x + rng.normal(size=n), "x": x})
    for predict_first in (True, False):
        scan = KalmanScan([1e-6, 1e-4, 1e-2], 1e-3, 1.0, predict_first)
        states, first = [], np.array([i % 2 == 0 for i in range(len(lengths))])
        for f in first:
            spread = rng.normal(size=(3, 2))
            entered = np.concatenate([np.r_[rng.normal(size=2), 1 + a * a, a * b, a * b, 1 + b * b] for a, b in spread])
            states.append(scan.start() if f else entered)
        got, group = scan.replay_all(rows, begins, states, first)
        summaries = scan.summarise_all(rows, begins, first)
        for g, (lo, hi) in enumerate(zip(begins[:-1], begins[1:])):
            after = scan.advance(states[g], summaries[g]).reshape(3, 6)
            for i, delta in enumerate(scan.deltas):
                part = got[(group == g) & (got["delta"] == delta)]
                state, q = tuple(states[g][6 * i : 6 * i + 6]), 0.0 if first[g] and not predict_first else delta
                for k, (_, row) in enumerate(part.iterrows()):
                    state, e, s = step(state, row["y"], row["x"], q, 1e-3)
                    q = delta
                    want = [state[1], state[0], e, s]
                    np.testing.assert_allclose([row["beta"], row["intercept"], row["error"], row["s"]], want, rtol=1e-9, atol=1e-9)
                assert k == hi - lo - 1
                np.testing.assert_allclose(after[i], state, rtol=1e-8, atol=1e-9)


def test_groups_are_whole_across_arrow_batches():
    import pyarrow as pa

    from tidepair.operators.scan import whole_groups

    keys = np.repeat(np.arange(40), np.arange(40) % 7)
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    for size in (1, 3, 10, 1000):
        seen = []
        for part, begins in whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"], at_once=5):
            assert begins[0] == 0 and begins[-1] == len(part)
            k = part.column("k").to_numpy()
            assert all(len(set(k[a:b])) == 1 for a, b in zip(begins[:-1], begins[1:]))
            seen += [k[a] for a in begins[:-1]]
        assert seen == sorted(set(keys))
    assert list(whole_groups(iter([]), ["k"])) == []


def loop(z, s, entry, exit_, rule, same, warmup=0):
    """Row-by-row statement of the rules."""
    side, opened, out = 0, 0.0, []
    for i, (zi, si) in enumerate(zip(z, s)):
        if i < warmup or np.isnan(zi):
            continue
        if rule == "abs":
            leave = side != 0 and abs(zi) < exit_
        else:
            leave = (side == 1 and zi > -exit_) or (side == -1 and zi < exit_)
        was_flat = side == 0
        if leave:
            out.append((i, f"EXIT_{'LONG' if side > 0 else 'SHORT'}", side * (si - opened)))
            side = 0
        if (was_flat or (leave and same)) and abs(zi) > entry:
            side, opened = (1 if zi < 0 else -1), si
            out.append((i, f"ENTRY_{'LONG' if side > 0 else 'SHORT'}", 0.0))
    return out


RULES = [("signed", True), ("signed", False), ("abs", False)]


@pytest.mark.parametrize("rule,same", RULES)
@pytest.mark.parametrize("seconds", [3 * 3600, 10**9])
def test_positions_match_loop(spark, rule, same, seconds):
    rng = np.random.default_rng(5)
    n = 600
    z = rng.normal(scale=1.5, size=n)
    z[rng.random(n) < 0.05] = np.nan
    pdf = walk_pairs(n).assign(z_score=z, spread=np.cumsum(rng.normal(size=n)))
    combos = [(1.0, 0.0), (2.0, 0.5), (2.5, 1.0), (9.0, 0.0)]
    df = from_pandas(spark, pdf)
    events = positions(df, ["leg_1", "leg_2"], combos, rule, same, warmup=30, seconds=seconds)
    got = trades(events).toPandas()
    for entry, exit_ in combos:
        part = got[(got["entry"] == entry) & (got["exit"] == exit_)]
        part = sorted(zip(part["idx"], part["type"], part["pnl"]), key=lambda t: (t[0], t[1].startswith("ENTRY")))
        want = loop(z, pdf["spread"], entry, exit_, rule, same, 30)
        assert [t[:2] for t in part] == [t[:2] for t in want]
        np.testing.assert_allclose([t[2] for t in part], [t[2] for t in want], atol=1e-9)


def test_three_rules_differ(spark):
    z = [0, -3, 0.2, -3, 3, 0]
    pdf = walk_pairs(6).assign(z_score=np.array(z, dtype=float), spread=np.arange(6.0))
    df = from_pandas(spark, pdf)
    counts = {}
    for rule, same in RULES:
        events = positions(df, ["leg_1", "leg_2"], [(2.0, 0.5)], rule, same)
        counts[rule, same] = sorted((r["idx"], r["type"]) for r in trades(events).collect())
    assert counts["signed", True][-1] == (5, "EXIT_SHORT")
    assert counts["signed", False][-1] == (4, "EXIT_LONG")
    assert counts["abs", False][-1] == (5, "EXIT_LONG")


def test_abs_rule_with_zero_exit_never_closes(spark):
    z = np.array([3.0, -3, 0, 0, 1, -1])
    df = from_pandas(spark, walk_pairs(6).assign(z_score=z, spread=z))
    events = positions(df, ["leg_1", "leg_2"], [(2.0, 0.0)], "abs")
    assert [r["is_exit"] for r in events.collect()] == [False]


def test_bars_carry_position_over_chunks(spark):
    z = np.array([0.0] * 5 + [3.0] + [1.0] * 40 + [-0.5] + [0.0] * 5)
    pdf = walk_pairs(len(z)).assign(z_score=z, spread=np.arange(len(z), dtype=float))
    bars = positions(from_pandas(spark, pdf), ["leg_1", "leg_2"], [(2.0, 0.0)], "signed", emit="bars", seconds=3600)
    got = bars.toPandas().sort_values("ts")
    assert list(got["position"]) == [0] * 5 + [-1] * 41 + [0] * 6
    assert got["points"].sum() == pytest.approx(-41.0)


def test_negated_pair_mirrors_sides(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(scale=2, size=200)
    base = walk_pairs(200).assign(z_score=z, spread=np.cumsum(z))
    flip = base.assign(z_score=-z, spread=-base["spread"])
    one, two = (
        positions(from_pandas(spark, p), ["leg_1", "leg_2"], [(2.0, 0.5)]).toPandas().sort_values(["pos", "is_exit"])
        for p in (base, flip)
    )
    assert list(one["side"]) == list(-two["side"])
    np.testing.assert_allclose(one["points"], two["points"], atol=1e-9)
