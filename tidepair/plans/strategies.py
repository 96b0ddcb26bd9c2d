"""A user's strategy over a batch: the same step object that runs on a stream, split in time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepair.functions.grouped import put_keys
from tidepair.operators.ordered import BLOCK, MONTH, add_blocks, spread_out, with_position
from tidepair.operators.pairs import PAIR
from tidepair.operators.scan import to_batch, to_frame, whole_groups
from tidepair.session import stage
from tidepair.streaming.processors import KeyedStep

#: Rows of a key that one task walks.
STEP_ROWS = 16_384


class Tracks:
    """One walk through a block from every mode a step can be in; walks that agree go on as one."""

    def __init__(self, step: KeyedStep, state: tuple, known):
        self.step = step
        modes = [known] if known is not None else list(step.modes)
        self.live = [([step.modes.index(m)], step.with_mode(state, m)) for m in modes]
        self.out: list[tuple[list[int], tuple]] = []

    def advance(self, row) -> None:
        moved = []
        for modes, state in self.live:
            state, emitted = self.step.advance(state, row)
            if emitted is not None:
                self.out.append((modes, emitted))
            same = next((k for k, (_, other) in enumerate(moved) if other == state), None)
            if same is None:
                moved.append((modes, state))
            else:
                # Rows given so far keep the modes they were given for.
                moved[same] = (moved[same][0] + modes, state)
        self.live = moved

    def exits(self) -> list[int]:
        """The mode a block is left in, by the mode it was entered in."""
        found = {m: self.step.modes.index(self.step.mode_of(state)) for modes, state in self.live for m in modes}
        return [found.get(m, -1) for m in range(len(self.step.modes))]


def _fields(schema: str, keys: Sequence[str]) -> tuple[str, list[str]]:
    parts = [p.strip() for p in schema.split(",")]
    own = [p for p in parts if p.split()[0] not in keys]
    return ", ".join(own), [p.split()[0] for p in own]


def run_strategy(
    df: DataFrame,
    step: KeyedStep,
    schema: str,
    keys: Sequence[str] = PAIR,
    ts: str = "ts",
    block_rows: int = STEP_ROWS,
    seconds: int = MONTH,
) -> DataFrame:
    """Rows that ``step`` emits when it goes through each key of ``df`` in time order.

    A key is cut into blocks of ``block_rows`` rows, each a task of its own. The step says how many
    rows settle its state (``memory``): these are copied in front of a block and walked without
    giving anything. What they cannot settle is one of a few ``modes``, such as the position held:
    the block is walked from each of them, and once the modes that blocks are left in have been
    followed through the key, the rows of the right walk are kept. A step whose memory has no
    bound goes through a key in one walk (``walk_strategy``); filters are ``ChunkScan``s.
    """
    keys = list(keys)
    if step.memory is None:
        return walk_strategy(df, step, schema, keys, ts)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    own_ddl, own = _fields(schema, keys)
    ddl = f"{kinds}, {BLOCK} bigint, modes array<int>, exits array<int>, {own_ddl}"
    target = to_arrow_schema(T._parse_datatype_string(ddl))
    numbered = with_position(df, keys, [ts], "_pos", seconds)
    blocked = add_blocks(numbered, "_pos", step.memory, max(block_rows, step.memory + 1))
    group = [*keys, BLOCK]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, group):
            pdf = to_frame(table)
            rows = []
            for lo, hi in zip(begins[:-1], begins[1:]):
                part = pdf.iloc[lo:hi]
                key = tuple(part[group].iloc[0])
                state, tracks = step.start(), None
                for row in part.itertuples(index=False):
                    if not row[own_at]:
                        state = step.advance(state, row)[0]
                        continue
                    if tracks is None:
                        tracks = Tracks(step, state, step.mode_of(state) if row[pos_at] == 1 and len(step.modes) > 1 else None)
                    tracks.advance(row)
                if tracks is not None:
                    rows += [(*key, modes, None, *emitted) for modes, emitted in tracks.out]
                    rows.append((*key, None, tracks.exits(), *[None] * len(own)))
            if rows:
                yield to_batch(pd.DataFrame(rows, columns=[*group, "modes", "exits", *own], dtype=object), target)

    columns = [c for c in blocked.columns if c not in ("_own", "_pos")] + ["_pos", "_own"]
    pos_at, own_at = len(columns) - 2, len(columns) - 1
    dealt = spread_out(blocked.select(*columns), *group).sortWithinPartitions(*group, "_pos")
    walked = dealt.mapInArrow(walk, ddl)
    if len(step.modes) == 1:
        return walked.where("modes is not null").select(*[c.split()[0] for c in schema.split(", ")])
    walked = stage(walked, "walks")

    def follow(key, pdf):
        """The mode that enters each block, from the modes blocks are left in."""
        mode, entered = first, []
        for block, exits in sorted(zip(pdf[BLOCK], pdf["exits"])):
            entered.append((block, mode))
            mode = int(exits[mode])
        return put_keys(pd.DataFrame(entered, columns=["_b", "_mode"]), [f"_{k}" for k in keys], key)

    first = step.modes.index(step.mode_of(step.start()))
    entry_ddl = ", ".join(f"_{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", _b bigint, _mode int"
    entries = walked.where("exits is not null").select(*group, "exits").groupBy(*keys).applyInPandas(follow, entry_ddl)
    rows = walked.where("modes is not null")
    met = [rows[k].eqNullSafe(entries[f"_{k}"]) for k in keys]
    kept = rows.join(entries, [*met, rows[BLOCK] == entries["_b"], F.array_contains("modes", F.col("_mode"))])
    return kept.select(*[c.split()[0] for c in schema.split(", ")])


def walk_strategy(df: DataFrame, step: KeyedStep, schema: str, keys: Sequence[str] = PAIR, ts: str = "ts") -> DataFrame:
    """One walk a key, for steps whose state nothing but the whole past settles.

    Rows stream through sorted partitions with one state in hand, so memory doesn't grow with a
    key's rows, but a key is walked by one task.
    """
    keys = list(keys)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            for key, row in zip(pdf[keys].itertuples(index=False, name=None), pdf.itertuples(index=False)):
                if key != current:
                    current, state = key, step.start()
                state, emitted = step.advance(state, row)
                if emitted is not None:
                    out.append((*key, *emitted))
            if out:
                yield pd.DataFrame(out, columns=list(step.columns))

    return df.repartition(*keys).sortWithinPartitions(*keys, ts).mapInPandas(run, schema)
