"""Order-dependent operators that never put a whole series into one task.

A window over ``symbol`` alone sends every row of a hot symbol to one task. Each operator here
works in two levels instead: a window over (keys, time chunk) does the bulk of the work, one
small summary row per (keys, chunk) is scanned to find what enters each chunk, and that carry is
joined back on (keys, chunk), the partitioning the local window needs anyway. Rolling frames use
blocks of consecutive row positions whose last rows are copied into the next block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
BLOCK = "_block"
DAY = 86_400
MONTH = 30 * DAY
BLOCK_ROWS = 65_536
CHUNK_ROWS = 4_000_000


def chunk_of(ts: str | Column, seconds: int) -> Column:
    """Number of the time chunk that holds ``ts``; monotone in ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def add_chunk(df: DataFrame, ts: str = "ts", seconds: int = MONTH) -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(ts, seconds))


def keyed_chunk(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """``add_chunk`` for operators that join what enters a chunk back on the keys.

    That join would lose rows whose key is null, so a null key is an error. A null-safe join
    would cost another exchange, since windows on the keys couldn't use its partitioning.
    """
    chunk = chunk_of(ts, seconds)
    for key in keys:
        chunk = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"null in key column {key}")).cast("bigint")).otherwise(chunk)
    return df.withColumn(CHUNK, chunk)


PARTS = 256


def chunk_cuts(chunked: DataFrame, keys: Sequence[str], ts: str, max_rows: int) -> DataFrame:
    """(keys, chunk, _cuts): timestamps that part the chunks of more than ``max_rows`` rows.

    They are quantiles out of a mergeable sketch over the crowded chunks alone. All of it is one
    plan: where the counts show that no chunk is crowded, adaptive execution drops the sketch and
    the joins behind it. A crowded chunk is parted in about twice as many as it needs, ``PARTS`` at
    most.
    """
    counted = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    quantiles = [i / PARTS for i in range(1, PARTS)]
    sketch = F.percentile_approx(F.unix_micros(ts), quantiles, F.lit(10_000))
    sketched = chunked.join(counted, [*keys, CHUNK]).groupBy(*keys, CHUNK).agg(F.any_value("_n").alias("_n"), sketch.alias("_q"))
    parts = F.least(F.ceil(F.col("_n") * 2 / max_rows), F.lit(PARTS)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_q", F.floor(i * PARTS / parts).cast("int") - 1))
    return sketched.select(*keys, CHUNK, F.array_distinct(picked).alias("_cuts"))


def cut_chunks(chunked: DataFrame, keys: Sequence[str], ts: str, cuts: DataFrame) -> DataFrame:
    """Renumber chunks so that those with ``cuts`` fall into up to ``PARTS`` parts, in time order.
    Rows of one timestamp stay together."""
    at = F.unix_micros(ts)
    part = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < at)), F.lit(0))
    joined = chunked.join(cuts, [*keys, CHUNK], "left")
    return joined.withColumn(CHUNK, F.col(CHUNK) * PARTS + part).select(*chunked.columns)


def fitted_chunks(chunked: DataFrame, keys: Sequence[str], ts: str, max_rows: int | None) -> DataFrame:
    """``chunked`` with crowded chunks cut; without ``max_rows`` as it is."""
    return chunked if max_rows is None else cut_chunks(chunked, keys, ts, chunk_cuts(chunked, keys, ts, max_rows))


def spread_out(df: DataFrame, *cols: str) -> DataFrame:
    """Partition by ``cols`` into the session's full number of shuffle partitions.

    Adaptive execution merges partitions by bytes, which would fold groups that are small but
    slow to compute into a few tasks; a given number is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def order_key(order: Sequence[str]) -> Column:
    """What ``max_by`` and ``min_by`` order by. One plain column keeps the aggregate hash-based;
    a struct, needed for tie-breakers, makes Spark sort each partition first."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _local(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _with_carry(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    aggregates: Sequence[Column],
    carried: dict[str, Callable[[WindowSpec], Column]],
    max_rows: int | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Summarise each chunk, scan the summaries per key, join the result back to the rows.

    With ``max_rows`` chunks that hold more rows than one task should get are cut at quantiles,
    all within the plan. ``edges`` is a frame with the same summaries as ``df`` that is cheaper to
    scan.
    """
    rows = keyed_chunk(df, keys, ts, seconds)
    source = rows if edges is None else keyed_chunk(edges, keys, ts, seconds)
    if max_rows is not None:
        cuts = chunk_cuts(source, keys, ts, max_rows)
        rows, source = (cut_chunks(frame, keys, ts, cuts) for frame in (rows, source))
    summary = source.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = summary.select(*keys, CHUNK, *[f(across).alias(name) for name, f in carried.items()])
    return rows.join(carry, [*keys, CHUNK], "left")


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: dict[str, str],
    seconds: int = MONTH,
    following: bool = False,
    max_rows: int | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Add columns of the previous (or ``following``) row of the same key.

    ``cols`` maps new column to source column; ``order`` starts with the timestamp. For raw data
    of uneven density give ``max_rows``, the most rows a chunk may hold.
    """
    pick, shift = (F.min_by, F.lead) if following else (F.max_by, F.lag)
    key = order_key(order)
    edge = lambda out: lambda w: shift(f"_e_{out}").over(w)
    chunked = _with_carry(
        df,
        keys,
        order[0],
        seconds,
        [pick(src, key).alias(f"_e_{out}") for out, src in cols.items()],
        {f"_c_{out}": edge(out) for out in cols},
        max_rows,
        edges,
    )
    local = _local(keys, order)
    inside = shift(F.lit(True)).over(local).isNotNull()
    return chunked.select(
        *df.columns,
        *[
            F.when(inside, shift(src).over(local)).otherwise(F.col(f"_c_{out}")).alias(out)
            for out, src in cols.items()
        ],
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str | Column],
    seconds: int = MONTH,
    max_rows: int | None = None,
) -> DataFrame:
    """Add running sums up to and including each row. Use integers where exactness matters, and
    ``max_rows`` as in ``with_neighbour``."""
    source = {out: F.col(c) if isinstance(c, str) else c for out, c in sums.items()}
    before = lambda out: lambda w: F.sum(f"_t_{out}").over(
        w.rowsBetween(Window.unboundedPreceding, -1)
    )
    chunked = _with_carry(
        df,
        keys,
        order[0],
        seconds,
        [F.sum(c).alias(f"_t_{out}") for out, c in source.items()],
        {f"_b_{out}": before(out) for out in source},
        max_rows,
    )
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    return chunked.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(c).over(upto), zero) + F.coalesce(F.col(f"_b_{out}"), zero)).alias(out)
            for out, c in source.items()
        ],
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "pos",
    seconds: int = MONTH,
    max_rows: int | None = None,
) -> DataFrame:
    """Add the 1-based row position within each key; ``max_rows`` as in ``with_neighbour``."""
    before = lambda w: F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chunked = _with_carry(df, keys, order[0], seconds, [], {"_before": before}, max_rows)
    local = F.row_number().over(_local(keys, order)).cast("bigint")
    return chunked.select(*df.columns, (local + F.coalesce(F.col("_before"), F.lit(0))).alias(out))


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: dict[str, str],
    seconds: int = MONTH,
    max_rows: int | None = None,
) -> DataFrame:
    """Forward fill: the latest non-null value at or before each row; ``max_rows`` as above."""
    at = order_key(order)
    before = lambda out: lambda w: F.last(f"_l_{out}", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)
    )
    chunked = _with_carry(
        df,
        keys,
        order[0],
        seconds,
        [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{out}") for out, c in cols.items()],
        {f"_b_{out}": before(out) for out in cols},
        max_rows,
    )
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c not in cols]
    return chunked.select(
        *kept,
        *[
            F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_b_{out}")).alias(out)
            for out, c in cols.items()
        ],
    )


def with_drawdown(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    seconds: int = MONTH,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``equity`` (running sum), ``peak`` (running maximum of it) and ``drawdown``;
    ``max_rows`` as in ``with_neighbour``."""
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    chunked = fitted_chunks(keyed_chunk(df, keys, order[0], seconds), keys, order[0], max_rows)
    rows = chunked.withColumn("_cum", F.sum(value).over(upto))
    # A chunk's own total and the highest point it reaches above its start.
    summary = rows.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_total"), F.max("_cum").alias("_top"))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        summary.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
        .withColumn("_peak", F.max(F.col("_start") + F.col("_top")).over(earlier))
        .select(*keys, CHUNK, "_start", "_peak")
    )
    joined = rows.join(carry, [*keys, CHUNK], "left").withColumn("equity", F.col("_start") + F.col("_cum"))
    peak = F.greatest(F.max("equity").over(upto), F.col("_peak"))
    return (
        joined.withColumn("peak", peak)
        .withColumn("drawdown", F.col("equity") - F.col("peak"))
        .select(*df.columns, "equity", "peak", "drawdown")
    )


def add_blocks(df: DataFrame, pos: str, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy each row into its block of ``block_rows`` positions, and the last ``halo`` rows of a
    block into the next one. ``_own`` tells a block's own rows from the copied ones."""
    if not 0 <= halo < block_rows:
        raise ValueError("halo must be shorter than a block")
    at = F.col(pos) - 1
    home = F.floor(at / F.lit(block_rows)).cast("bigint")
    if halo == 0:
        return df.withColumn(BLOCK, home).withColumn("_own", F.lit(True))
    spills = (at % block_rows) >= block_rows - halo
    blocks = F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(BLOCK, F.explode(blocks)).withColumn("_own", F.col(BLOCK) == home)


def with_rolling(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    rows: int,
    specs: dict[str, Callable[[WindowSpec], Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Evaluate window expressions over the trailing ``rows`` rows, current one included."""
    blocked = add_blocks(df, pos, rows - 1, max(block_rows, rows))
    frame = Window.partitionBy(*keys, BLOCK).orderBy(pos).rowsBetween(-(rows - 1), 0)
    return (
        blocked.select("*", *[f(frame).alias(out) for out, f in specs.items()])
        .where("_own")
        .select(*df.columns, *specs)
    )
