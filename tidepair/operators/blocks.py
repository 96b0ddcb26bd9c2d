"""Sums over the common rows of all pairs of series, as products of block matrices.

Series are numbered within hash blocks and timestamps hashed into slabs. A task holds a strip of
slabs for two blocks: each slab becomes two dense matrices whose products hold the sums of all
pairs, and the strip's products are added up before anything is written. What is exchanged is the
rows of these matrices, so the volume follows the number of strips, not that of slabs or of pair
rows; pair rows arise once, behind the last addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.operators.ordered import spread_out

#: Sums of a pair: rows in common, values, squares and products of its legs.
SUMS = ["n", "sy", "sx", "syy", "sxx", "sxy"]
#: Slabs whose products one task adds up.
SLABS_PER_STRIP = 8

_AREA = ["_b1", "_b2", "_strip"]
_ROW = "_b1 int, _b2 int, _i int, n array<double>, sy array<double>, sx array<double>, syy array<double>, sxx array<double>, sxy array<double>"
_ROW_SCHEMA = pa.schema([pa.field(c, pa.int32()) for c in ("_b1", "_b2", "_i")] + [pa.field(c, pa.list_(pa.float64())) for c in SUMS])


def _dense(slot: np.ndarray, at: np.ndarray, v: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and their presence as (time, series) matrices."""
    width = int(at.max()) + 1 if len(at) else 0
    values, seen = np.zeros((n_slots, width)), np.zeros((n_slots, width))
    values[slot, at] = v
    seen[slot, at] = 1.0
    if seen.sum() != len(at):
        raise ValueError("a symbol has several rows at one timestamp; de-duplicate first")
    return values, seen


def slab_products(same: bool, times: np.ndarray, left: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(sum, series, series) products of one slab; ``left`` marks rows of the first block."""
    stamps, slot = np.unique(times, return_inverse=True)
    y, has_y = _dense(slot[left], at[left], v[left], len(stamps))
    x, has_x = (y, has_y) if same else _dense(slot[~left], at[~left], v[~left], len(stamps))
    return np.stack([has_y.T @ has_x, y.T @ has_x, has_y.T @ x, (y * y).T @ has_x, has_y.T @ (x * x), y.T @ x])


def add_up(one: np.ndarray | None, two: np.ndarray) -> np.ndarray:
    """Sum of two stacks of matrices; the smaller one lacks series that came later in their block."""
    if one is None:
        return two
    shape = np.maximum(one.shape, two.shape)
    out = np.zeros(shape)
    for part in (one, two):
        out[tuple(slice(0, n) for n in part.shape)] += part
    return out


def _matrix_rows(b1: int, b2: int, sums: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows ``rows`` of a stack of matrices, one record each."""
    width = sums.shape[2]
    ends = pa.array(np.arange(0, width * len(rows) + 1, width, dtype=np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(m[rows]).ravel())) for m in sums]
    fixed = [np.full(len(rows), b, dtype=np.int32) for b in (b1, b2)] + [rows.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, fixed), *lists], schema=_ROW_SCHEMA)


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the strips of a sorted partition, slab after slab."""
    area, slab, held, total = None, None, [], None

    def closed(total):
        parts = [np.concatenate(c) for c in zip(*held, strict=True)]
        return add_up(total, slab_products(area[0] == area[1], *parts))

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*_AREA, "_slab")], axis=1)
        times, left, at, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ts_us", "_left", "_at", "v"))
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if lo == hi:
                continue
            now, now_slab = tuple(key[lo, :3].tolist()), int(key[lo, 3])
            if held and (now, now_slab) != (area, slab):
                total, held = closed(total), []
            if area is not None and now != area:
                yield _matrix_rows(area[0], area[1], total, np.flatnonzero(total[0].any(axis=1)))
                total = None
            area, slab = now, now_slab
            held.append((times[lo:hi], left[lo:hi], at[lo:hi], v[lo:hi]))
    if area is not None:
        total = closed(total)
        yield _matrix_rows(area[0], area[1], total, np.flatnonzero(total[0].any(axis=1)))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal matrix rows of a sorted partition."""
    key, total = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("_b1", "_b2", "_i")), strict=True))
        ends = np.cumsum(pc.list_value_length(batch.column("n")).to_numpy(zero_copy_only=False))
        flat = np.stack([batch.column(c).flatten().to_numpy() for c in SUMS])
        done = []
        for k, lo, hi in zip(keys, [0, *ends[:-1]], ends, strict=True):
            if key is not None and k != key:
                done.append((key, total))
                total = None
            key, total = k, add_up(total, flat[:, None, lo:hi])
        for (b1, b2, i), row in done:
            yield _numbered(b1, b2, i, row)
    if key is not None:
        yield _numbered(*key, total)


def _numbered(b1: int, b2: int, i: int, row: np.ndarray) -> pa.RecordBatch:
    out = _matrix_rows(b1, b2, row, np.zeros(1, dtype=np.int64))
    return out.set_column(2, "_i", pa.array([i], type=pa.int32()))


def matrix_rows(rows: DataFrame, blocks, slabs) -> DataFrame:
    """(_b1, _b2, _i, sums...) of strips: row ``_i`` of the matrices of two blocks of series.

    ``rows`` holds (_home, _at, ts_us, v): a series' block, its number there, time and value.
    """
    slab = F.pmod(F.xxhash64("ts_us"), slabs).cast("int")
    cells = (
        rows.withColumn("_slab", slab)
        .withColumn("_strip", F.floor(F.col("_slab") / SLABS_PER_STRIP).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.least("_home", "_other").alias("_b1"),
            F.greatest("_home", "_other").alias("_b2"),
            "_strip",
            "_slab",
            "ts_us",
            (F.col("_home") <= F.col("_other")).alias("_left"),
            "_at",
            "v",
        )
    )
    return spread_out(cells, *_AREA).sortWithinPartitions(*_AREA, "_slab").mapInArrow(_strips, _ROW)


def added(strips: DataFrame) -> DataFrame:
    """The matrices of all strips added up, still a row of them in a record."""
    key = ["_b1", "_b2", "_i"]
    return strips.repartition(*key).sortWithinPartitions(*key).mapInArrow(_added, _ROW)
