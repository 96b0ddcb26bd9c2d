"""Registry of queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepair.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; zone-less timestamps go out so that any client reads the same clock."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(use_utc(spark), sf_dir)
            stamps = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
            return df.select(
                *[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if c in stamps else F.col(f"`{c}`") for c in df.columns]
            )

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round columns for reports; values that round to zero become plain zero."""
    for c in cols:
        v = F.col(c)
        df = df.withColumn(c, F.when(F.abs(v) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(v, digits)))
    return df
