"""Gated pairs of a wide universe: the gate stands where a pair's sums arise.

A series travels as one record, once to each tile of two blocks of series. A tile holds both
blocks over all timestamps, so a pair's sums are complete there: what fails the gate is never
written, and the rows of a pair that passes leave the task as they are, without a join or an
exchange. Where only the tests of these rows are wanted, the rows stay in the task as well. Series
are many and each fits a record; for few long ones ``pairs.pair_moments`` splits the time axis as
well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.functions import panel
from tidepair.operators.clean import known
from tidepair.operators.stats import _TINY_RSS

#: Cells (series x timestamps) of a block; a tile holds two blocks.
CELLS = 1_500_000
#: Pairs whose sums a task holds at once, and pair rows it writes at once.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 200_000
#: Pairs whose spreads a task holds at once to test them.
TESTED_AT_ONCE = 8_192

_MOMENTS = ["mean_y", "mean_x", "cyy", "cxx", "cxy"]
_LINES = "leg_1 string, leg_2 string, n bigint, mean_y double, mean_x double, cyy double, cxx double, cxy double"
_TESTS = f"{_LINES}, reversion double, half_life double, coint_stat double, p_value double, used_lag int"
_ROWS = "leg_1 string, leg_2 string, ts_us bigint, pos bigint, y double, x double, spread double"


class Block:
    """Series of a block: names, their order in the tile, and (series, time) matrices of values, presence and centred values."""

    def __init__(self, names: list[str], order: np.ndarray, values: np.ndarray, seen: np.ndarray) -> None:
        self.names, self.order, self.values, self.seen = names, order, values, seen
        self.has = seen.astype(np.float64)
        self.mean = values.sum(axis=1) / self.has.sum(axis=1)
        self.centred = np.where(seen, values - self.mean[:, None], 0.0)
        self.squares = self.centred * self.centred


def _order(name: str, rank) -> tuple:
    """What legs are ordered by: the rank (null, then values, then NaN), then the alphabet."""
    return (False, name) if rank is None else (True, rank != rank, 0 if rank != rank else rank, name)


def _blocks(names: list[str], orders: list[tuple], left: np.ndarray, sizes: np.ndarray, times: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, Block, Block]:
    """Timestamps of a tile, its left and its right block (the same one if it has no right side)."""
    stamps, slot = np.unique(times, return_inverse=True)
    values, seen = np.zeros((len(names), len(stamps))), np.zeros((len(names), len(stamps)), dtype=bool)
    row = np.repeat(np.arange(len(names)), sizes)
    values[row, slot] = v
    seen[row, slot] = True
    if seen.sum() != len(times):
        raise ValueError("a symbol has several rows at one timestamp; de-duplicate first")
    place = np.empty(len(names), dtype=np.int64)
    place[sorted(range(len(names)), key=orders.__getitem__)] = np.arange(len(names))
    sides = [Block([names[i] for i in at], place[at], values[at], seen[at]) for at in (np.flatnonzero(left), np.flatnonzero(~left)) if len(at)]
    return stamps, sides[0], sides[-1]


def _passing(one: Block, two: Block, min_rows: int, min_corr: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, turned, n, mean_y, mean_x, cyy, cxx, cxy) of the pairs that pass; a turned pair has ``j`` as its first leg."""
    step = max(PAIRS_AT_ONCE // len(two.names), 1)
    for lo in range(0, len(one.names), step):
        at = slice(lo, lo + step)
        n = one.has[at] @ two.has.T
        # In a block's product with itself every pair stands twice.
        late = np.arange(len(two.names)) > np.arange(len(one.names))[at, None] if one is two else True
        i, j = np.nonzero((n >= max(min_rows, 1)) & late)
        if not len(i):
            continue
        n = n[i, j]
        sy, sx = (one.centred[at] @ two.has.T)[i, j], (one.has[at] @ two.centred.T)[i, j]
        cyy = (one.squares[at] @ two.has.T)[i, j] - sy * sy / n
        cxx = (one.has[at] @ two.squares.T)[i, j] - sx * sx / n
        cxy = (one.centred[at] @ two.centred.T)[i, j] - sy * sx / n
        with np.errstate(divide="ignore", invalid="ignore"):
            good = (cyy > 0) & (cxx > 0) & (cxy / np.sqrt(cyy * cxx) >= min_corr)
        i, j, n, sy, sx, cyy, cxx, cxy = (c[good] for c in (i + lo, j, n, sy, sx, cyy, cxx, cxy))
        yield i, j, two.order[j] < one.order[i], n, one.mean[i] + sy / n, two.mean[j] + sx / n, cyy, cxx, cxy


def _legs(one: Block, two: Block, i: np.ndarray, j: np.ndarray, turned: np.ndarray) -> list[pa.Array]:
    """Names of both legs, the earlier one first."""
    names = pa.array([*one.names, *two.names], type=pa.string())
    j = j + len(one.names)
    return [names.take(pa.array(np.where(turned, a, b))) for a, b in ((j, i), (i, j))]


def _line_batches(stamps, one: Block, two: Block, min_rows: int, min_corr: float) -> Iterator[pa.RecordBatch]:
    for i, j, turned, n, my, mx, cyy, cxx, cxy in _passing(one, two, min_rows, min_corr):
        my, mx, cyy, cxx = np.where(turned, mx, my), np.where(turned, my, mx), np.where(turned, cxx, cyy), np.where(turned, cyy, cxx)
        columns = [*_legs(one, two, i, j, turned), pa.array(n.astype(np.int64)), *map(pa.array, (my, mx, cyy, cxx, cxy))]
        yield pa.RecordBatch.from_arrays(columns, names=["leg_1", "leg_2", "n", *_MOMENTS])


def _row_batches(stamps: np.ndarray, one: Block, two: Block, min_rows: int, min_corr: float) -> Iterator[pa.RecordBatch]:
    step = max(ROWS_AT_ONCE // len(stamps), 1)
    for i, j, turned, _, my, mx, cyy, cxx, cxy in _passing(one, two, min_rows, min_corr):
        my, mx, cxx = np.where(turned, mx, my), np.where(turned, my, mx), np.where(turned, cyy, cxx)
        beta = cxy / cxx
        alpha = my - beta * mx
        for lo in range(0, len(i), step):
            at = slice(lo, lo + step)
            both = one.seen[i[at]] & two.seen[j[at]]
            k, slot = np.nonzero(both)
            length = both.sum(axis=1)
            pos = np.arange(1, len(k) + 1) - np.repeat(np.cumsum(length) - length, length)
            a, b, back = one.values[i[at][k], slot], two.values[j[at][k], slot], turned[at][k]
            y, x = np.where(back, b, a), np.where(back, a, b)
            spread = y - alpha[at][k] - beta[at][k] * x
            legs = [c.take(pa.array(k)) for c in _legs(one, two, i[at], j[at], turned[at])]
            columns = [*legs, *map(pa.array, (stamps[slot], pos, y, x, spread))]
            yield pa.RecordBatch.from_arrays(columns, names=["leg_1", "leg_2", "ts_us", "pos", "y", "x", "spread"])


def _spreads(values: np.ndarray, seen: np.ndarray, y: np.ndarray, x: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Residuals over the common timestamps of each pair of rows ``y`` and ``x``, one series a row, zeros behind its end."""
    both = seen[y] & seen[x]
    length = both.sum(axis=1)
    out = np.zeros((len(y), int(length.max())))
    out[np.arange(out.shape[1]) < length[:, None]] = (values[y] - (alpha[:, None] + beta[:, None] * values[x]))[both]
    return out


def _test_batches(max_p: float | None, half_life_range: tuple[float, float] | None, stamps: np.ndarray, one: Block, two: Block, min_rows: int, min_corr: float) -> Iterator[pa.RecordBatch]:
    values, seen = (one.values, one.seen) if one is two else (np.concatenate([one.values, two.values]), np.concatenate([one.seen, two.seen]))
    for i, j, turned, n, my, mx, cyy, cxx, cxy in _passing(one, two, min_rows, min_corr):
        if not len(i):
            continue
        # Series of like length lie together, so that few cells are only behind an end.
        i, j, turned, n, my, mx, cyy, cxx, cxy = (c[np.argsort(n)] for c in (i, j, turned, n, my, mx, cyy, cxx, cxy))
        my, mx, cyy, cxx = np.where(turned, mx, my), np.where(turned, my, mx), np.where(turned, cxx, cyy), np.where(turned, cyy, cxx)
        other = j + (0 if one is two else len(one.names))
        y, x = np.where(turned, other, i), np.where(turned, i, other)
        beta = cxy / cxx
        alpha, corr, length = my - beta * mx, cxy / np.sqrt(cyy * cxx), n.astype(np.int64)
        speed, bars = np.full(len(i), np.nan), np.full(len(i), np.nan)
        stat, p, lags = np.full(len(i), -np.inf), np.zeros(len(i)), np.full(len(i), -1)
        perfect, kept = corr * corr >= _TINY_RSS, np.ones(len(i), dtype=bool)
        for lo in range(0, len(i), TESTED_AT_ONCE):
            tested, spreads = [], []
            for at in range(lo, min(lo + TESTED_AT_ONCE, len(i)), panel.AT_ONCE):
                few = slice(at, min(at + panel.AT_ONCE, lo + TESTED_AT_ONCE))
                series = _spreads(values, seen, y[few], x[few], alpha[few], beta[few])
                speed[few], bars[few] = panel.half_lives(series, length[few])
                if half_life_range is not None:
                    kept[few] = (bars[few] > half_life_range[0]) & (bars[few] < half_life_range[1])
                some = np.flatnonzero(kept[few] & ~perfect[few])
                tested.append(some + at)
                spreads.append(series[some])
            some = np.concatenate(tested)
            # The last of them are the longest.
            series = np.concatenate([np.pad(part, ((0, 0), (0, spreads[-1].shape[1] - part.shape[1]))) for part in spreads])
            stat[some], lags[some] = panel.level_tests(series, length[some])
            p[some] = panel.p_values(stat[some], 2)
        if max_p is not None:
            kept &= p < max_p
        names = _legs(one, two, i[kept], j[kept], turned[kept])
        floats = [pa.array(c[kept]) for c in (my, mx, cyy, cxx, cxy)]
        tests = [pa.array(c[kept], mask=np.isnan(c[kept])) for c in (speed, bars, stat, p)]
        columns = [*names, pa.array(length[kept]), *floats, *tests, pa.array(lags[kept].astype(np.int32), mask=lags[kept] < 0)]
        yield pa.RecordBatch.from_arrays(columns, names=["leg_1", "leg_2", "n", *_MOMENTS, "reversion", "half_life", "coint_stat", "p_value", "used_lag"])


def _tiles(write, min_rows: int, min_corr: float):
    """A map over sorted partitions that hands one tile after the other to ``write``."""

    def closed(tile, held):
        left = np.concatenate([part[1] for part in held])
        if tile[0] != tile[1] and (left.all() or not left.any()):
            return  # The other block has no series.
        names, orders = ([x for part in held for x in part[k]] for k in (0, 5))
        yield from write(*_blocks(names, orders, *(np.concatenate([part[k] for part in held]) for k in range(1, 5))), min_rows, min_corr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("_b1", "_b2")], axis=1)
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if lo == hi:
                    continue
                now, part = tuple(key[lo].tolist()), batch.slice(lo, hi - lo)
                if held and now != tile:
                    yield from closed(tile, held)
                    held = []
                tile = now
                sizes = pc.list_value_length(part.column("t")).to_numpy()
                times, v = (part.column(c).flatten().to_numpy() for c in ("t", "v"))
                names = part.column("symbol").to_pylist()
                ranks = part.column("_rank").to_pylist() if "_rank" in part.schema.names else [None] * len(names)
                held.append((names, part.column("_left").to_numpy(zero_copy_only=False), sizes, times, v, list(map(_order, names, ranks))))
        if held:
            yield from closed(tile, held)

    return run


def _cells(df: DataFrame, value: str, min_rows: int, cells: int, rank: DataFrame | None = None) -> DataFrame:
    """(_b1, _b2, _left, symbol, t, v, and _rank if there is one): series that are long enough, in each of their tiles."""
    valued = df.where(known(value) & F.col("symbol").isNotNull() & F.col("ts").isNotNull()).select("symbol", F.unix_micros("ts").alias("t"), F.col(value).alias("v"))
    many = valued.agg(F.approx_count_distinct("symbol").alias("series"), F.approx_count_distinct("t").alias("times")).first()
    # Enough tiles for all cores, and more where blocks would hold too many cells.
    spread = min(math.isqrt(4 * df.sparkSession.sparkContext.defaultParallelism), many["series"])
    blocks = max(-(-many["series"] // max(cells // max(many["times"], 1), 1)), spread, 1)
    points = F.sort_array(F.collect_list(F.struct("t", "v")))
    series = valued.groupBy("symbol").agg(points.alias("p")).where(F.size("p") >= min_rows)
    if rank is not None:
        series = series.join(rank.select("symbol", F.col("rank").alias("_rank")), "symbol")
    known_by = [c for c in series.columns if c != "p"]
    home: Column = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    placed = series.select(*known_by, F.col("p.t").alias("t"), F.col("p.v").alias("v"), home.alias("_home"))
    copies = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("_home", "_other").alias("_b1"),
        F.greatest("_home", "_other").alias("_b2"),
        (F.col("_home") <= F.col("_other")).alias("_left"),
        *known_by,
        "t",
        "v",
    )
    tile = ["_b1", "_b2"]
    return copies.repartition(blocks * (blocks + 1) // 2, *tile).sortWithinPartitions(*tile)


def gated_moments(df: DataFrame, value: str = "close", min_rows: int = 1, min_corr: float = 0.8, cells: int = CELLS) -> DataFrame:
    """``pairs.pair_moments`` of the pairs with ``min_rows`` rows and ``min_corr`` in common.

    Expects one row per (symbol, ts).
    """
    return _cells(df, value, min_rows, cells).mapInArrow(_tiles(_line_batches, min_rows, min_corr), _LINES)


def gated_rows(df: DataFrame, value: str = "close", min_rows: int = 1, min_corr: float = 0.8, cells: int = CELLS) -> DataFrame:
    """(leg_1, leg_2, ts, pos, y, x, spread): numbered rows of these pairs with the residuals of their lines."""
    rows = _cells(df, value, min_rows, cells).mapInArrow(_tiles(_row_batches, min_rows, min_corr), _ROWS)
    return rows.select("leg_1", "leg_2", F.timestamp_micros("ts_us").alias("ts"), "pos", "y", "x", "spread")


def gated_tests(
    df: DataFrame,
    value: str = "close",
    min_rows: int = 1,
    min_corr: float = 0.8,
    max_p: float | None = None,
    half_life_range: tuple[float, float] | None = None,
    rank: DataFrame | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """``gated_moments`` with ``stats.half_life`` and ``stats.coint`` of each pair's residuals, whose rows never leave the tile.

    Pairs beyond ``max_p`` or on or beyond the ends of ``half_life_range`` are left out; only those within the range are
    tested. The first leg is the one earlier in the alphabet or with the lower ``rank(symbol, rank)``, which names a symbol
    once; symbols without a rank are left out.
    """
    write = partial(_test_batches, max_p, half_life_range)
    return _cells(df, value, min_rows, cells, rank).mapInArrow(_tiles(write, min_rows, min_corr), _TESTS)
