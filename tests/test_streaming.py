"""Streams over several micro-batches equal the batch operators over the same rows."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tests.helpers import from_pandas, walk_pairs
from tidepair.operators.clean import valid_ticks
from tidepair.operators.kalman import kalman
from tidepair.operators.ordered import with_position
from tidepair.operators.positions import positions
from tidepair.streaming import jobs
from tidepair.streaming.processors import SIGNAL, SNAPSHOT, KeyedStep, PriceBoard

TICK = "symbol string, ts timestamp, price double"


@pytest.fixture(scope="module")
def ticks():
    pdf = walk_pairs(240, step="7min")
    parts = [
        pd.DataFrame({"symbol": "A", "ts": pdf["ts"], "price": pdf["y"]}),
        pd.DataFrame({"symbol": "B", "ts": pdf["ts"] + pd.Timedelta(seconds=50), "price": pdf["x"]}),
    ]
    return pd.concat(parts).sort_values("ts", ignore_index=True)


@pytest.fixture
def landed(spark, ticks, tmp_path):
    """The ticks as five files, landed in time order."""
    folder = str(tmp_path / "in")
    for part in np.array_split(np.arange(len(ticks)), 5):
        from_pandas(spark, ticks.iloc[part].reset_index(drop=True)).coalesce(1).write.mode("append").parquet(folder)
    return jobs.file_stream(spark, folder, TICK, max_files=1)


PAIRS = [("A", "B")]


def closed(ticks, width="15min", delay="10min"):
    last = ticks["ts"].max() - pd.Timedelta(delay)
    bars = ticks.assign(ts=ticks["ts"].dt.floor(width)).groupby(["symbol", "ts"], as_index=False)["price"].last()
    return bars[bars["ts"] + pd.Timedelta(width) <= last]


def test_resample_equals_batch(spark, ticks, landed):
    got = jobs.run_append(jobs.resample(landed, "15 minutes", "10 minutes"), "bars").toPandas()
    want = closed(ticks).rename(columns={"price": "close"})
    key = ["symbol", "ts"]
    got, want = (d.sort_values(key, ignore_index=True) for d in (got, want))
    assert list(got["ts"]) == list(want["ts"])
    np.testing.assert_array_equal(got["close"], want["close"])


def test_signals_equal_batch(spark, ticks, landed):
    pairs = spark.createDataFrame(PAIRS, "leg_1 string, leg_2 string")
    updates = jobs.pair_updates(landed, pairs, "15 minutes", "10 minutes")
    got = jobs.run_append(jobs.signals(updates, entry=0.3, exit_=0.15), "signals").toPandas().sort_values("ts")
    wide = closed(ticks).pivot(index="ts", columns="symbol", values="price").ffill().dropna().reset_index()
    rows = from_pandas(spark, wide.rename(columns={"A": "y", "B": "x"}).assign(leg_1="A", leg_2="B"))
    scored = kalman(with_position(rows, ["leg_1", "leg_2"], ["ts"]))
    want = positions(scored, ["leg_1", "leg_2"], [(0.3, 0.15)], "abs").toPandas().sort_values("ts")
    assert len(want) > 5
    assert list(got["ts"]) == list(want["ts"])
    np.testing.assert_allclose(got["z_score"], want["z_score"], rtol=1e-9)
    assert list(got["side"]) == list(want["side"])


def test_snapshots_wait_for_both_legs(spark, landed):
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "leg_1 string, leg_2 string")
    updates = jobs.pair_updates(landed, pairs, "15 minutes", "10 minutes")
    got = jobs.run_append(jobs.ready_snapshots(updates), "snapshots").toPandas()
    assert set(got["leg_2"]) == {"B"} and got[["y", "x"]].notna().all().all()


def test_latest_price_over_batches(spark, ticks, landed):
    known = spark.createDataFrame([("A", "KA")], "con_id string, key string")
    stream = valid_ticks(landed.withColumnRenamed("symbol", "con_id"), known)
    path = jobs.run_batches(jobs.latest_prices(stream), "latest", jobs.table_sink, "update")
    written = spark.read.parquet(path)
    assert written.select("batch").distinct().count() >= 5
    last = written.groupBy("key").agg(F.max_by("price", F.struct("ts", "batch")).alias("p")).first()
    assert (last["key"], last["p"]) == ("KA", ticks[ticks["symbol"] == "A"]["price"].iloc[-1])


def test_gate_cools_down_across_batches(spark, tmp_path):
    base = pd.Timestamp("2024-01-01 10:00:00")
    rows = [(0, "ENTRY_LONG_SPREAD"), (30, "EXIT_ALL"), (70, "HOLD"), (75, "EXIT_ALL"), (100, "EXIT_ALL"), (200, "NOPE")]
    folder = str(tmp_path / "signals")
    for second, kind in rows:
        pdf = pd.DataFrame(
            {"leg_1": ["A"], "leg_2": "B", "ts": base + pd.Timedelta(seconds=second), "signal_type": kind, "side": np.int32(1)}
        )
        df = from_pandas(spark, pdf).withColumn("side", F.col("side").cast("int"))
        for c in ("y", "x", "z_score", "beta", "predicted_y", "error"):
            df = df.withColumn(c, F.lit(1.0))
        df.coalesce(1).write.mode("append").parquet(folder)

    def passed(**limits):
        stream = jobs.file_stream(spark, folder, SIGNAL, max_files=1)
        out = jobs.run_append(jobs.order_gate(stream, **limits), "gate").orderBy("ts").toPandas()
        return [int((t - base).total_seconds()) for t in out["ts"]]

    assert passed(cooldown_s=60) == [0, 75]
    assert passed(cooldown_s=0, max_per_minute=1) == [0, 75]
    assert passed(cooldown_s=0, forbidden_hours=[10]) == []


def drained(stream, path):
    """Run a stream to its end and return its batches' progress."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


class Echo(KeyedStep):
    """Gives every row it is stepped with."""

    state_schema = "seen long"
    columns = ["leg_1", "leg_2", "ts", "y", "x"]

    def start(self):
        return (0,)

    def advance(self, state, row):
        return (state[0] + 1,), (row.ts, row.y, row.x)


def test_ticks_are_merged_before_they_meet_pairs(spark, ticks, landed, tmp_path):
    legs = ["A", "B", "C", "D", "E", "F"]
    chosen = [("A", "B")] + [("A", x) for x in legs[2:]] + [("B", x) for x in legs[2:]]
    pairs = spark.createDataFrame(chosen, "leg_1 string, leg_2 string")
    updates = jobs.pair_updates(landed, pairs, "15 minutes", "10 minutes")
    progress = drained(jobs.keyed(updates, Echo(), SNAPSHOT), str(tmp_path / "out"))
    # Every pair holds A or B: the step sees each pair once a bucket in which one of its legs traded.
    bars = closed(ticks)
    buckets = {s: set(bars[bars["symbol"] == s]["ts"]) for s in ("A", "B")}
    want = sum(len(set.union(*(buckets.get(leg, set()) for leg in pair))) for pair in chosen)
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == want
    # The first merge updates a row per symbol, bucket and batch at most, however many pairs there are;
    # ticks never meet pairs.
    merged = [sum(p["stateOperators"][k]["numRowsUpdated"] for p in progress) for k in range(len(progress[0]["stateOperators"]))]
    all_bars = ticks.assign(ts=ticks["ts"].dt.floor("15min")).groupby(["symbol", "ts"]).ngroups
    assert min(merged) <= all_bars + 2 * len(progress) and sum(p["numInputRows"] for p in progress) == len(ticks)


def test_gate_forgets_pairs_after_the_cooldown(spark, tmp_path):
    base, folder = pd.Timestamp("2024-01-01 10:00:00"), str(tmp_path / "signals")
    # Ten pairs signal once; later only one pair does.
    batches = [[(f"P{i}", 0) for i in range(10)], [("P0", 600)], [("P0", 1200)], [("P0", 7200)]]
    for rows in batches:
        pdf = pd.DataFrame({"leg_1": [r[0] for r in rows], "leg_2": "X", "ts": [base + pd.Timedelta(seconds=r[1]) for r in rows], "signal_type": "EXIT_ALL"})
        df = from_pandas(spark, pdf).withColumn("side", F.lit(1))
        for c in ("y", "x", "z_score", "beta", "predicted_y", "error"):
            df = df.withColumn(c, F.lit(1.0))
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, SIGNAL, max_files=1)
    progress = drained(jobs.order_gate(stream, cooldown_s=60, delay="1 minute"), str(tmp_path / "out"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) >= 10 and held[-1] < max(held) / 2
    passed = spark.read.parquet(str(tmp_path / "out/data"))
    assert passed.count() == 13
    assert {r["leg_1"]: r["count"] for r in passed.groupBy("leg_1").count().collect()} == {"P0": 4, **{f"P{i}": 1 for i in range(1, 10)}}


def test_idle_pairs_are_forgotten(spark, tmp_path):
    folder = str(tmp_path / "ticks")
    base = pd.Timestamp("2024-01-01")
    for hours in ([0, 1], [3, 4], [6, 7], [30, 31]):
        symbols = ["A", "B", "C", "D"] if hours[0] == 0 else ["A", "B"]
        rows = [(s, base + pd.Timedelta(hours=h, seconds=i), 10.0 + i + h) for h in hours for i, s in enumerate(symbols)]
        from_pandas(spark, pd.DataFrame(rows, columns=["symbol", "ts", "price"])).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, TICK, max_files=1)
    pairs = spark.createDataFrame([("A", "B"), ("C", "D")], "leg_1 string, leg_2 string")
    updates = jobs.pair_updates(stream, pairs, "1 hour", "10 minutes")
    step = jobs.idle_for(PriceBoard(), 12 * 3600)
    progress = drained(jobs.keyed(updates, step, SNAPSHOT), str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out/data")).toPandas()
    assert set(found["leg_1"]) == {"A", "C"} and (found["leg_1"] == "C").sum() == 2
    held = [next(o["numRowsTotal"] for o in p["stateOperators"] if "transformWithState" in o["operatorName"]) for p in progress]
    # Both pairs are held while they trade; at the end only what the last watermark has not passed.
    assert max(held) >= 4 and held[-1] < max(held)


def test_latest_price_state_goes_with_its_period(spark, tmp_path):
    folder = str(tmp_path / "ticks")
    base = pd.Timestamp("2024-01-01")
    for day in range(4):
        rows = [(f"K{day}-{i}", base + pd.Timedelta(days=day, minutes=i), 1.0 + i) for i in range(20)]
        from_pandas(spark, pd.DataFrame(rows, columns=["key", "ts", "price"])).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, "key string, ts timestamp, price double", max_files=1)
    sink = jobs.table_sink(str(tmp_path / "out"))
    query = jobs.latest_prices(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) <= 40 and held[-1] <= 20
    assert spark.read.parquet(str(tmp_path / "out")).select("key").distinct().count() == 80


def test_monitor_defaults(spark, landed, tmp_path):
    shape = lambda df: jobs.monitor_rows(df.withColumn("y", F.lit(None).cast("double")), "ts", "y", "price")
    path = jobs.run_batches(landed, "monitor", lambda p: jobs.csv_sink(p, shape))
    log = spark.read.option("header", True).csv(f"{path}/batch=*")
    assert log.columns == ["Timestamp", "ASSET_A", "ASSET_B", "Spread", "Z-Score"]
    assert {r["ASSET_A"] for r in log.select("ASSET_A").distinct().collect()} == {"0.0"}
