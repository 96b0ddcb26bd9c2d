"""Mean-reversion speed and unit-root evidence of pair spreads."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepair.functions import unit_root
from tidepair.operators.ordered import BLOCK, BLOCK_ROWS, add_blocks, spread_out
from tidepair.operators.pairs import PAIR
from tidepair.operators.scan import whole_groups

_TINY_RSS = 1.0 - 100.0 * float(np.sqrt(np.finfo(float).eps))


def half_life(
    spreads: DataFrame,
    keys: Sequence[str] = PAIR,
    value: str = "spread",
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Half-life in bars from the regression of the change on the previous level.

    The first change counts twice (the series is padded at its start with its own first change);
    a slope that is not negative gives infinity. One aggregate over (previous, change) points; the neighbour comes from
    blocks of positions, so a long series is many tasks.
    """
    blocked = add_blocks(spreads.select(*keys, pos, value), pos, 1, block_rows)
    before = F.lag(value).over(Window.partitionBy(*keys, BLOCK).orderBy(pos))
    points = (
        blocked.withColumn("_lag", before)
        .where(F.col("_own") & F.col("_lag").isNotNull())
        .select(
            *keys,
            F.col("_lag"),
            (F.col(value) - F.col("_lag")).alias("_ret"),
            F.when(F.col(pos) == 2, F.lit(2.0)).otherwise(F.lit(1.0)).alias("_w"),
        )
    )
    w, lag, ret = F.col("_w"), F.col("_lag"), F.col("_ret")
    sums = points.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * lag).alias("sl"),
        F.sum(w * ret).alias("sr"),
        F.sum(w * lag * lag).alias("sll"),
        F.sum(w * lag * ret).alias("slr"),
    )
    down = F.col("n") * F.col("sll") - F.col("sl") * F.col("sl")
    slope = (F.col("n") * F.col("slr") - F.col("sl") * F.col("sr")) / F.when(down > 0, down)
    return sums.select(*keys, slope.alias("reversion")).withColumn(
        "half_life",
        F.when(F.col("reversion") >= 0, F.lit(float("inf"))).otherwise(-F.log(F.lit(2.0)) / F.col("reversion")),
    )


def adf(
    spreads: DataFrame,
    keys: Sequence[str] = PAIR,
    value: str = "spread",
    pos: str = "pos",
    n: str = "n",
    constant: bool = True,
    lags: int | None = None,
    n_vars: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Augmented Dickey-Fuller statistic and p-value per key; ``lags`` None picks by AIC.

    ``spreads`` holds numbered rows and the series length ``n``. Each block of positions is
    reduced to a small triangular factor; the factors of a key are merged and solved. Candidate
    lags share the factor of the common sample. The chosen lag's longer sample adds only rows at
    the series start, which the first block returns as well.
    """
    # Blocks overlap by the given lags, or by those that a series of 10^9 rows would choose.
    halo = (unit_root.max_lag(10**9, constant) if lags is None else lags) + 1
    width = max(block_rows, 2 * halo + 2)

    cols = lambda top: top + 2 + (1 if constant else 0)

    def solve(total: int, top: int, triangles: list[np.ndarray], head: np.ndarray) -> tuple:
        tri = triangles[0] if len(triangles) == 1 else unit_root.triangle(np.vstack(triangles))
        nobs = total - 1 - top
        used = unit_root.choose_lag(tri, nobs, constant) if lags is None else top
        if used < top:
            extra = unit_root.design(head, used, used + 1, constant)
            keep = list(range(cols(top) - 1 - (top - used))) + [cols(top) - 1]
            tri = unit_root.triangle(np.vstack([tri[:, keep], extra]))
            nobs = total - 1 - used
        stat = unit_root.level_t(tri, used, nobs, constant)
        return stat, unit_root.p_value(stat, n_vars), used, nobs

    def reduce_block(values: np.ndarray, at: int, own: int, total: int) -> tuple | None:
        """Triangle and head of a block, or the outcome of a series that is one block; ``own`` rows were copied
        into it, its first one stands at ``at``."""
        top = unit_root.max_lag(total, constant) if lags is None else lags
        if top >= halo:
            raise ValueError(f"{top} lags need blocks that overlap by more than {halo} rows")
        if top < 0 or total <= top + 3 or own == len(values):
            return None
        first = max(own, top + 1 - at)
        rows = unit_root.design(values, top, first, constant) if first < len(values) else np.zeros((0, cols(top)))
        tri, head = unit_root.triangle(rows), values[: top + 1] if at == 0 else values[:0]
        if total <= width:
            return total, top, None, None, *solve(total, top, [tri], head)
        return total, top, tri.ravel(), head, None, None, None, None

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spreads.select(*keys).schema)
    found = "adf_stat double, p_value double, used_lag int, n_obs bigint"
    parts = f"{kinds}, block bigint, n bigint, top int, tri array<double>, head array<double>, {found}"
    part_schema, out_schema = (to_arrow_schema(T._parse_datatype_string(ddl)) for ddl in (parts, f"{kinds}, {found}"))

    def batch(table: pa.Table, at: list[int], rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        """Rows of results behind the named columns of the groups that begin at ``at``."""
        known = table.select(names).take(pa.array(at, type=pa.int64())).combine_chunks()
        own = zip(*rows, strict=True) if rows else [[]] * (len(schema) - len(names))
        arrays = [*(known.column(c).cast(schema.field(i).type) for i, c in enumerate(names)), *own]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, type=f.type) for c, f in zip(arrays, schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def reduce_blocks(batches):
        for table, begins in whole_groups(batches, [*keys, BLOCK]):
            values, pos, total, own = (table.column(c).to_numpy() for c in ("_v", "_pos", "_n", "_own"))
            copied = np.concatenate([[0], np.cumsum(~own.astype(bool))])
            done = {}
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
                out = reduce_block(values[lo:hi], int(pos[lo]) - 1, int(copied[hi] - copied[lo]), int(total[lo]))
                if out is not None:
                    done[lo] = out
            yield batch(table, list(done), list(done.values()), [*keys, BLOCK], part_schema)

    def solve_series(batches):
        for table, begins in whole_groups(batches, keys):
            rows = table.drop_columns(list(keys)).to_pylist()
            done = []
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
                one = rows[lo]
                if one["tri"] is None:
                    done.append((one["adf_stat"], one["p_value"], one["used_lag"], one["n_obs"]))
                else:
                    width_ = cols(one["top"])
                    triangles = [np.asarray(r["tri"]).reshape(width_, width_) for r in rows[lo:hi]]
                    done.append(solve(one["n"], one["top"], triangles, np.asarray(one["head"])))
            yield batch(table, begins[:-1].tolist(), done, list(keys), out_schema)

    # A series that is one block is solved where it lies; of others the triangles meet.
    named = spreads.select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(pos).alias("_pos"), F.col(n).alias("_n")
    )
    blocked = add_blocks(named, "_pos", halo, width)
    reduced = spread_out(blocked, *keys, BLOCK).sortWithinPartitions(*keys, BLOCK, "_pos").mapInArrow(reduce_blocks, parts)
    return reduced.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(solve_series, f"{kinds}, {found}")


def coint(numbered: DataFrame, stats: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Engle-Granger test per pair: unit-root test of the residuals without a constant, p-value
    for two variables. A pair that fits perfectly gets minus infinity and p 0."""
    tested = adf(numbered, PAIR, constant=False, n_vars=2, block_rows=block_rows)
    perfect = F.col("corr") * F.col("corr") >= _TINY_RSS
    return stats.join(tested, PAIR, "left").select(
        *stats.columns,
        F.when(perfect, F.lit(float("-inf"))).otherwise(F.col("adf_stat")).alias("coint_stat"),
        F.when(perfect, F.lit(0.0)).otherwise(F.col("p_value")).alias("p_value"),
        "used_lag",
    )


def dickey_fuller_lag0(
    spreads: DataFrame,
    keys: Sequence[str] = PAIR,
    value: str = "spread",
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Unit-root t-statistic without lagged changes, in closed form from one aggregate."""
    blocked = add_blocks(spreads.select(*keys, pos, value), pos, 1, block_rows)
    before = F.lag(value).over(Window.partitionBy(*keys, BLOCK).orderBy(pos))
    points = (
        blocked.withColumn("lag", before)
        .where(F.col("_own") & F.col("lag").isNotNull())
        .withColumn("ret", F.col(value) - F.col("lag"))
    )
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.regr_sxx("ret", "lag").alias("sxx"),
        F.regr_syy("ret", "lag").alias("syy"),
        F.regr_sxy("ret", "lag").alias("sxy"),
    )
    error = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n_obs") - 2)
    return sums.select(
        *keys,
        "n_obs",
        (F.col("sxy") / F.col("sxx")).alias("slope"),
        (F.col("sxy") / F.col("sxx") / F.sqrt(error / F.col("sxx"))).alias("adf_stat"),
    )
