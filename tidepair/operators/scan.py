"""Stateful scans over ordered series, split in time and still exact.

A scan carries a small state along a series. Run as one group per series it would put a whole
series into one task. Here each (series, time chunk) is dealt out on its own: the chunk is first
reduced to a summary of what it does to *any* state that enters it, the summaries of a series (one
small row per chunk) are folded in order to give every chunk its entry state, and the chunk is
then replayed from that state. Only chunks that have a successor are reduced, so a series that
fits one chunk is read once. A task reads its sorted partition as a stream and hands many chunks
at once to the scan, which may work on all of them together.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepair.functions.grouped import put_keys
from tidepair.operators.ordered import CHUNK, MONTH, add_chunk, fitted_chunks, spread_out

#: Rows of whole chunks that are handed to a scan at once.
AT_ONCE = 65_536


class ChunkScan(ABC):
    """What a scan must know about a chunk. States and summaries are flat float vectors."""

    #: DDL of the columns that ``replay`` returns, without the keys.
    schema: str

    @abstractmethod
    def start(self) -> np.ndarray:
        """State before the first row of a series."""

    @abstractmethod
    def summarise(self, rows: pd.DataFrame, first: bool) -> np.ndarray:
        """Effect of the chunk's ordered rows on any entry state; ``first`` chunk of its series."""

    @abstractmethod
    def advance(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        """State after a chunk, from the state before it."""

    @abstractmethod
    def replay(self, rows: pd.DataFrame, state: np.ndarray, first: bool) -> pd.DataFrame:
        """Output rows of a chunk entered with ``state``."""

    def summarise_all(self, rows: pd.DataFrame, begins: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """``summarise`` for chunks that lie one behind the other; chunk i is rows begins[i] to begins[i + 1]."""
        return [self.summarise(rows.iloc[a:b].reset_index(drop=True), bool(f)) for a, b, f in zip(begins[:-1], begins[1:], first)]

    def replay_all(
        self, rows: pd.DataFrame, begins: np.ndarray, states: list[np.ndarray], first: np.ndarray
    ) -> tuple[pd.DataFrame, np.ndarray]:
        """``replay`` for chunks that lie one behind the other; also the chunk of each output row."""
        parts = [
            self.replay(rows.iloc[a:b].reset_index(drop=True), state, bool(f))
            for a, b, state, f in zip(begins[:-1], begins[1:], states, first)
        ]
        return pd.concat(parts, ignore_index=True), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _begins(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows of a sorted table at which a new key begins."""
    new = np.ones(len(table), dtype=bool)
    if len(table) > 1:
        new[1:] = False
        for k in keys:
            one, two = table.column(k).slice(1), table.column(k).slice(0, len(table) - 1)
            differ = pc.fill_null(pc.not_equal(one, two), False)
            lacks = pc.not_equal(one.is_null(), two.is_null())
            new[1:] |= pc.or_(differ, lacks).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], at_once: int = AT_ONCE) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups out of a sorted stream, and where each group begins (and the end)."""
    held, rows, enough = [], 0, at_once
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begins = _begins(table, keys)
        if len(begins) > 1:
            yield table.slice(0, begins[-1]), begins
            held = table.slice(begins[-1]).to_batches()
            rows, enough = sum(b.num_rows for b in held), at_once
        else:
            # One group alone so far: look again when it has doubled.
            held, enough = table.to_batches(), 2 * rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_begins(table, keys), len(table))


def to_frame(table: pa.Table) -> pd.DataFrame:
    """Plain columns; timestamps as the UTC clock that sessions are pinned to."""
    for i, field in enumerate(table.schema):
        if pa.types.is_timestamp(field.type):
            table = table.set_column(i, field.name, table.column(i).cast(pa.timestamp("us", "UTC")).cast(pa.timestamp("us")))
    return table.to_pandas()


def to_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(frame[f.name], type=f.type, from_pandas=True) for f in schema], schema=schema)


def with_keys(out: pd.DataFrame, group: np.ndarray, rows: pd.DataFrame, begins: np.ndarray, keys: Sequence[str]) -> pd.DataFrame:
    """``out`` with the keys of the group that each of its rows belongs to."""
    for k in keys:
        out[k] = rows[k].to_numpy()[begins[:-1]][group]
    return out


def run_scan(
    df: DataFrame,
    scan: ChunkScan,
    keys: Sequence[str],
    ts: str = "ts",
    seconds: int = MONTH,
    max_rows: int | None = None,
) -> DataFrame:
    """Run ``scan`` over each key of ``df`` in time order.

    A chunk is held by one worker; ``max_rows`` cuts those that are too full at quantiles of time.
    """
    keys = list(keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    rows = fitted_chunks(add_chunk(df, ts, seconds), keys, ts, max_rows)
    # One small row per chunk that holds data, with its neighbours.
    order = Window.partitionBy(*keys).orderBy(CHUNK)
    present = (
        rows.select(*keys, CHUNK)
        .distinct()
        .withColumn("after", F.lag(CHUNK).over(order))
        .withColumn("_next", F.lead(CHUNK).over(order))
    )

    summary_ddl, out_ddl = f"{kinds}, chunk bigint, summary array<double>", f"{kinds}, {scan.schema}"
    summary_schema, out_schema = (to_arrow_schema(T._parse_datatype_string(ddl)) for ddl in (summary_ddl, out_ddl))
    group = [*keys, CHUNK]

    def reduce_chunks(batches):
        for table, begins in whole_groups(batches, group):
            pdf = to_frame(table)
            found = scan.summarise_all(pdf, begins, pdf["_first"].to_numpy()[begins[:-1]])
            out = pdf[group].iloc[begins[:-1]].rename(columns={CHUNK: "chunk"})
            yield to_batch(out.assign(summary=list(found)), summary_schema)

    def fold(key, pdf):
        state, chunks, states = scan.start(), [], []
        for chunk, summary in sorted(zip(pdf["chunk"], pdf["summary"]), key=lambda pair: pair[0]):
            state = scan.advance(state, np.asarray(summary))
            chunks.append(chunk)
            states.append(state)
        return put_keys(pd.DataFrame({"after": chunks, "state": states}), keys, key)

    def replay_chunks(batches):
        for table, begins in whole_groups(batches, group):
            # A chunk that something enters begins with a row that holds only the state.
            head = table.column("_state").is_valid().to_numpy()
            entered = head[begins[:-1]]
            given = iter(table.column("_state").filter(pa.array(head)).to_pylist())
            states = [np.asarray(next(given)) if e else scan.start() for e in entered]
            pdf = to_frame(table.drop_columns("_state").filter(pa.array(~head)))
            begins = begins - np.concatenate([[0], np.cumsum(entered)])
            out, of = scan.replay_all(pdf, begins, states, ~entered)
            yield to_batch(with_keys(out, of, pdf, begins, keys), out_schema)

    followed = present.where(F.col("_next").isNotNull()).select(
        *keys, CHUNK, F.col("after").isNull().alias("_first")
    )
    summaries = (
        spread_out(rows.join(followed, group), *group)
        .sortWithinPartitions(*group, ts)
        .mapInArrow(reduce_chunks, summary_ddl)
    )
    states = summaries.groupBy(*keys).applyInPandas(fold, f"{kinds}, after bigint, state array<double>")
    # The state after a chunk enters the next chunk that has rows.
    entries = present.join(states, [*keys, "after"]).select(*group, F.col("state").alias("_state"))
    stateless = rows.withColumn("_state", F.lit(None).cast("array<double>"))
    return (
        spread_out(stateless.unionByName(entries, allowMissingColumns=True), *group)
        .sortWithinPartitions(*group, F.col("_state").isNull(), ts)
        .mapInArrow(replay_chunks, out_ddl)
    )
