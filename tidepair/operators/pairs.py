"""Pairs of series: all-pair moments without emitting pair rows, and aligned rows of chosen pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepair.operators.blocks import SUMS, added, matrix_rows
from tidepair.operators.clean import known

PAIR = ["leg_1", "leg_2"]
SYMBOLS_PER_BLOCK = 256
TIMES_PER_SLAB = 4096

def _shares(df: DataFrame, col: str, per_share: int) -> Column:
    """How many hash shares keep about ``per_share`` distinct values each, counted in the plan."""
    n = df.agg(F.ceil(F.approx_count_distinct(col) / per_share).cast("int").alias("n"))
    return F.greatest(n.scalar(), F.lit(1))


def _numbered_series(df: DataFrame, min_rows: int, n_blocks: int | None, rank: DataFrame | None) -> tuple[DataFrame, Column]:
    """(symbol, _mean, _order, _home, _at) of the series that are long enough, and the number of blocks.

    ``_order`` decides which leg comes first: the symbol, or its catalogue rank.
    """
    series = (
        df.groupBy("symbol")
        .agg(F.avg("v").alias("_mean"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_rows)
        .drop("_n")
    )
    if rank is not None:
        series = series.join(rank.select("symbol", F.struct(F.col("rank"), F.col("symbol")).alias("_order")), "symbol")
    else:
        series = series.withColumn("_order", F.struct("symbol"))
    blocks = _shares(series, "symbol", SYMBOLS_PER_BLOCK) if n_blocks is None else F.lit(n_blocks)
    series = series.withColumn("_home", F.pmod(F.xxhash64("symbol"), blocks).cast("int"))
    place = F.row_number().over(Window.partitionBy("_home").orderBy("_order")) - 1
    return series.withColumn("_at", place.cast("int")), blocks


def pair_moments(
    df: DataFrame,
    value: str = "close",
    min_rows: int = 1,
    n_blocks: int | None = None,
    n_slabs: int | None = None,
    rank: DataFrame | None = None,
) -> DataFrame:
    """Sums over the common timestamps of every unordered pair of symbols.

    Expects one row per (symbol, ts). Rows of two symbols are never joined, and no row of a pair
    is exchanged: timestamps are hashed into slabs and symbols into blocks, matrix products give
    the sums of all pairs of two blocks, and the matrices are added up before they are taken
    apart (see ``blocks``). Symbols with fewer than ``min_rows`` rows cannot form a pair that long
    and are left out first. Values are taken relative to the symbol's mean so that the sums keep
    their digits. The first leg is the one earlier in the alphabet, or with the lower
    ``rank(symbol, rank)``; symbols without a rank are left out.
    """
    valued = df.where(known(value)).select("symbol", "ts", F.col(value).alias("v"))
    series, blocks = _numbered_series(valued, min_rows, n_blocks, rank)
    slabs = _shares(valued, "ts", TIMES_PER_SLAB) if n_slabs is None else F.lit(n_slabs)
    rows = valued.join(series, "symbol").select("_home", "_at", F.unix_micros("ts").alias("ts_us"), (F.col("v") - F.col("_mean")).alias("v"))
    sums = added(matrix_rows(rows, blocks, slabs))
    # A block's series in the order of their numbers; a block is bounded by its size.
    members = series.groupBy("_home").agg(F.array_sort(F.collect_list(F.struct("_at", "symbol", "_mean", "_order"))).alias("s"))
    one = members.select(F.col("_home").alias("_b1"), F.col("s").alias("_s1"))
    two = members.select(F.col("_home").alias("_b2"), F.col("s").alias("_s2"))
    rows = sums.join(one, "_b1").join(two, "_b2")
    entries = F.posexplode(F.arrays_zip(*SUMS, "_s2")).alias("_j", "e")
    rows = rows.select("_b1", "_b2", "_i", F.get("_s1", F.col("_i")).alias("a"), entries)
    # In a block's product with itself every pair stands twice.
    rows = rows.where((F.col("e.n") >= max(min_rows, 1)) & ((F.col("_b1") < F.col("_b2")) | (F.col("_i") < F.col("_j"))))
    turned = F.col("e._s2._order") < F.col("a._order")
    legs = lambda y, x: (F.when(turned, F.col(x)).otherwise(F.col(y)), F.when(turned, F.col(y)).otherwise(F.col(x)))
    names, means, s1, s2 = legs("a.symbol", "e._s2.symbol"), legs("a._mean", "e._s2._mean"), legs("e.sy", "e.sx"), legs("e.syy", "e.sxx")
    n = F.col("e.n")
    return rows.select(
        names[0].alias("leg_1"),
        names[1].alias("leg_2"),
        n.cast("bigint").alias("n"),
        (means[0] + s1[0] / n).alias("mean_y"),
        (means[1] + s1[1] / n).alias("mean_x"),
        (s2[0] - s1[0] * s1[0] / n).alias("cyy"),
        (s2[1] - s1[1] * s1[1] / n).alias("cxx"),
        (F.col("e.sxy") - F.col("e.sy") * F.col("e.sx") / n).alias("cxy"),
    )


def swap_legs(moments: DataFrame) -> DataFrame:
    """The same pairs with the roles of the two legs exchanged."""
    return moments.select(
        F.col("leg_2").alias("leg_1"),
        F.col("leg_1").alias("leg_2"),
        "n",
        F.col("mean_x").alias("mean_y"),
        F.col("mean_y").alias("mean_x"),
        F.col("cxx").alias("cyy"),
        F.col("cyy").alias("cxx"),
        "cxy",
    )


def orient(moments: DataFrame, rank: DataFrame) -> DataFrame:
    """Put the leg with the lower catalogue ``rank(symbol, rank)`` first, in one pass over the pairs.

    Pairs that are still to be made take ``pair_moments(rank=...)`` instead, which joins the
    ranks to the symbols.
    """
    r1 = rank.select(F.col("symbol").alias("leg_1"), F.col("rank").alias("_r1"))
    r2 = rank.select(F.col("symbol").alias("leg_2"), F.col("rank").alias("_r2"))
    ranked = moments.join(r1, "leg_1").join(r2, "leg_2")
    turned = F.col("_r1") > F.col("_r2")
    partner = {"leg_1": "leg_2", "mean_y": "mean_x", "cyy": "cxx"}
    partner |= {v: k for k, v in partner.items()}
    pick = lambda c: F.when(turned, F.col(partner[c])).otherwise(F.col(c)).alias(c) if c in partner else F.col(c)
    return ranked.select(*[pick(c) for c in moments.columns])


def both_directions(moments: DataFrame) -> DataFrame:
    return moments.unionByName(swap_legs(moments))


def _positive(col: str) -> Column:
    return F.when(F.col(col) > 0, F.col(col))


def hedge_stats(moments: DataFrame) -> DataFrame:
    """Correlation, least-squares line of ``y`` on ``x`` and its residual spread, from moments; other columns are kept."""
    slope = F.col("cxy") / _positive("cxx")
    residual = F.greatest(F.col("cyy") - F.col("cxy") * F.col("cxy") / _positive("cxx"), F.lit(0.0))
    return moments.select(
        *PAIR,
        "n",
        "mean_y",
        "mean_x",
        (F.col("cxy") / F.sqrt(_positive("cyy") * _positive("cxx"))).alias("corr"),
        slope.alias("beta"),
        (F.col("mean_y") - slope * F.col("mean_x")).alias("alpha"),
        F.sqrt(residual / (F.col("n") - 1)).alias("resid_std"),
        (F.sqrt(residual / (F.col("n") - 1)) / F.col("mean_y")).alias("vol_pct"),
        # Line through the origin, from uncentred sums.
        (
            (F.col("cxy") + F.col("n") * F.col("mean_y") * F.col("mean_x"))
            / (F.col("cxx") + F.col("n") * F.col("mean_x") * F.col("mean_x"))
        ).alias("beta_origin"),
        *[c for c in moments.columns if c not in {*PAIR, "n", "mean_y", "mean_x", "cyy", "cxx", "cxy"}],
    )


def correlation_matrix(df: DataFrame, value: str) -> DataFrame:
    """Long-form symmetric correlation matrix, diagonal included."""
    pairs = hedge_stats(pair_moments(df, value)).select(*PAIR, "corr")
    mirrored = pairs.select(F.col("leg_2").alias("leg_1"), F.col("leg_1").alias("leg_2"), "corr")
    own = df.where(known(value)).select("symbol").distinct()
    diagonal = own.select(F.col("symbol").alias("leg_1"), F.col("symbol").alias("leg_2"), F.lit(1.0).alias("corr"))
    return pairs.unionByName(mirrored).unionByName(diagonal)


def pair_bars(df: DataFrame, pairs: DataFrame, value: str = "close") -> DataFrame:
    """Aligned rows ``(leg_1, leg_2, ts, y, x)`` of the chosen pairs, common timestamps only.

    ``pairs`` is the outcome of a gate (or a hand-made list) and small next to the rows; read it
    from a written table. The gate stands below the pair join on both sides: rows of first legs
    meet their pairs, and of the rows on the other side only those of second legs are exchanged.
    The join is on (symbol, ts), which spreads any one symbol over all tasks.
    """
    valued = df.where(known(value)).select("symbol", "ts", F.col(value).alias("v"))
    extra = [c for c in pairs.columns if c not in PAIR]
    y = valued.select(F.col("symbol").alias("leg_1"), "ts", F.col("v").alias("y"))
    x = valued.select(F.col("symbol").alias("leg_2"), "ts", F.col("v").alias("x"))
    x = x.join(pairs.select("leg_2"), "leg_2", "left_semi")
    return y.join(pairs, "leg_1").join(x, ["leg_2", "ts"]).select(*PAIR, "ts", "y", "x", *extra)


def list_pairs(df: DataFrame, value: str = "close", min_rows: int = 1, **options) -> DataFrame:
    """All unordered pairs that share at least ``min_rows`` timestamps, with that count."""
    return pair_moments(df, value, min_rows, **options).select(*PAIR, "n")
