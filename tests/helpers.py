"""Frames from small hand-made rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def at(text: str) -> pd.Timestamp:
    return pd.Timestamp(text)


def frame(spark, rows, schema):
    """Rows with timestamps given as text; ``ts`` columns become timestamps."""
    fields = [f.strip().split() for f in schema.split(",")]
    plain = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in fields)
    df = spark.createDataFrame(rows, plain)
    for name, kind in fields:
        if kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df


def from_pandas(spark, pdf: pd.DataFrame):
    """A frame whose timestamps are read as UTC."""
    stamps = [c for c in pdf.columns if pdf[c].dtype.kind == "M"]
    plain = pdf.assign(**{c: pdf[c].astype("int64") // (1000 if pdf[c].dtype == "datetime64[ns]" else 1) for c in stamps})
    df = spark.createDataFrame(plain)
    for c in stamps:
        df = df.withColumn(c, F.timestamp_micros(F.col(c)))
    return df


def walk_pairs(n: int, seed: int = 0, step: str = "15min", start: str = "2024-01-01") -> pd.DataFrame:
    """One pair of random walks with a mean-reverting spread."""
    rng = np.random.default_rng(seed)
    x = 1000 + np.cumsum(rng.normal(size=n))
    noise = np.zeros(n)
    for i in range(1, n):
        noise[i] = 0.9 * noise[i - 1] + rng.normal()
    return pd.DataFrame(
        {
            "leg_1": "A",
            "leg_2": "B",
            "ts": pd.date_range(start, periods=n, freq=step),
            "pos": np.arange(1, n + 1),
            "y": 5 + 1.7 * x + noise,
            "x": x,
        }
    )
