"""Periodic runs of words: a sparse dynamic program over lag diagonals.

Cell (i, lag) of the program holds how many words up to word i equal the word ``lag`` before
them. Only cells where a word has an earlier occurrence at that lag exist, and a run of period q
is a stretch of the diagonal lag = q. Three facts keep the program sparse and exact:

- A run of period q needs max(12 - q, q) matches in a row, so it holds a whole aligned block of
  b words with 2 b - 1 <= max(12 - q, q). A diagonal so advances by blocks, not words, and only
  lags of one band (b <= lag / 2) are served by blocks of b words: a block has few earlier
  occurrences in its band, however repetitive the text is, and all of them are followed.
- Blocks that occur once in a text open no diagonal, and no longer block does where they lie, so
  names of blocks of 2 b words are made of those of b words that repeat: plain prose ends early.
- A diagonal that a block does not extend has ended: its ends are found by names of shorter
  blocks, and it is a run if it is long enough and no smaller period has the same two ends.

So n words cost O(n log n) cells at worst (a text of one word alone), and hardly any in prose.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.llm import text as tx

#: A run has this many words at least, and two periods.
LEAST = 12
#: Blocks of the first band have 4 words every 3 words, for lags up to 14.
_FIRST_BLOCK, _FIRST_STEP, _FIRST_LAGS = 4, 3, 14
_NONE = np.int64(-1)


def _names(groups: np.ndarray) -> np.ndarray:
    """A number for each distinct value that occurs twice or more; -1 for the others."""
    if not len(groups):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(groups, kind="stable")
    new = np.diff(groups[order], prepend=groups[order[0]] - 1) != 0
    number = np.cumsum(new) - 1
    out = np.empty(len(groups), dtype=np.int64)
    out[order] = np.where(np.bincount(number)[number] > 1, number, _NONE)
    return out


def _doubled(short: np.ndarray, size: int) -> np.ndarray:
    """Names of blocks of twice ``size`` words; -1 where the block occurs once in its text."""
    out = np.full(len(short), _NONE)
    at = np.flatnonzero((short[: len(short) - size] >= 0) & (short[size:] >= 0)) if len(short) > size else np.zeros(0, dtype=np.int64)
    if len(at):
        out[at] = _names(short[at] * (short.max() + 1) + short[at + size])
    return out


def _meetings(name: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of aligned blocks and all their earlier occurrences at lags low to high."""
    known = np.flatnonzero(name >= 0)
    span = len(name) + high + 1
    # Occurrences by name and place; a band of lags is one interval of that order.
    listed = np.sort(name[known] * span + known)
    at = known[known % step == 0]
    begin = np.searchsorted(listed, name[at] * span + np.maximum(at - high, 0))
    count = np.searchsorted(listed, name[at] * span + at - low, side="right") - begin
    count = np.maximum(count, 0)
    place = np.repeat(at, count)
    first = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else count
    earlier = listed[first + np.arange(len(place))] % span
    return place, place - earlier


def _extension(names: list[np.ndarray], at: np.ndarray, lag: np.ndarray, sign: int) -> np.ndarray:
    """Matches in a row from ``at`` on (sign 1) or before ``at`` (sign -1), fewer than twice the longest block given."""
    got = np.zeros(len(at), dtype=np.int64)
    for level in range(len(names) - 1, -1, -1):
        size, name = 1 << level, names[level]
        place = at + got if sign > 0 else at - got - size
        fine = (place - lag >= 0) & (place < len(name))
        p, q = place[fine], (place - lag)[fine]
        same = np.zeros(len(at), dtype=bool)
        same[fine] = (name[p] >= 0) & (name[p] == name[q])
        got += size * same
    return got


def diagonals(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lag) of all stretches that are long enough to be runs, over many texts at once.

    ``words`` are the words' hashes, ``text_of`` the text of each; blocks of different texts are
    never equal, as their first words' names differ.
    """
    name = _names(tx.mix(words + tx.mix(text_of.astype(np.uint64) + np.uint64(1))))
    names = [name, _doubled(name, 1)]
    names.append(_doubled(names[1], 2))
    found = []
    block, step, low, high = _FIRST_BLOCK, _FIRST_STEP, 1, _FIRST_LAGS
    while names[-1].size and (names[-1] >= 0).any():
        place, lag = _meetings(names[-1], step, low, high)
        # A diagonal's blocks in a row are one stretch; it ends where the next one is missing.
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        opens = np.ones(len(place), dtype=bool)
        opens[1:] = (np.diff(lag) != 0) | (np.diff(place) != step)
        first = place[opens]
        last = place[np.append(opens[1:], True)] + block if len(place) else place
        lag = lag[opens]
        shorter = names[: max(1, step.bit_length())]
        first = first - _extension(shorter, first, lag, -1)
        last = last + _extension(shorter, last, lag, 1)
        fine = last - first + lag >= np.maximum(LEAST, 2 * lag)
        found.append((first[fine] - lag[fine], last[fine] - 1, lag[fine]))
        names.append(_doubled(names[-1], block))
        block *= 2
        step, low, high = block, 2 * block - 1, 4 * block - 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and then period.

    Two lags with the same ends are one run of the smaller period: a run has two periods of it
    at least, so each of its periods up to half its length is a multiple of the smallest.
    """
    start, end, lag = diagonals(words, text_of)
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    least = np.ones(len(start), dtype=bool)
    least[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, length, lag = start[least], (end - start + 1)[least], lag[least]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; ``runs`` holds (start, length, period) by start and period.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared as they stand. ``collapsed`` is
    the text without all repeats: a word that stands in a run after that run's first period is
    dropped, the others are joined by one blank. A null or blank text has no words, no runs and
    an empty ``collapsed``. Repeated rows get equal results; an empty table gives an empty one.
    """

    def fn(batch, texts):
        words = tx.Words(texts, lower=False)
        counts = np.diff(words.first)
        text_of = np.repeat(np.arange(len(texts)), counts)
        start, length, period = runs(words.hashes, text_of)
        owner = text_of[start] if len(start) else start
        # +1 where a repeat begins, -1 behind it: words at depth 0 stay.
        depth = np.zeros(len(text_of) + 1, dtype=np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        kept = np.cumsum(depth[:-1]) == 0
        collapsed = []
        thinned = np.zeros(len(texts), dtype=bool)
        thinned[owner] = True
        for i, data in enumerate(texts):
            own = data.split()
            if thinned[i]:
                own = [own[k] for k in np.flatnonzero(kept[words.first[i] : words.first[i + 1]])]
            collapsed.append(b" ".join(own))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        fields = [pa.array(x.astype(np.int64)) for x in (start - words.first[owner] if len(start) else start, length, period)]
        listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        return batch.column("doc_id"), counts, listed, pa.array(collapsed, type=pa.binary()).cast(pa.string())

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return tx.map_texts(rows, fn, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with known periods: where crc32(doc_id) is divisible by ten, the words from a
    place on repeat the first few of them. Other texts keep their words, joined by one blank.

    A null doc_id counts as an empty decimal; texts without words stay without.
    """

    def fn(batch, texts):
        out = []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            words = data.split()
            n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
            if h % 10 == 0 and n:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                head = words[a : a + p]
                words = words[:a] + (head * ((n - a) // p + 1))[: n - a]
            out.append(b" ".join(words))
        return batch.column("doc_id"), pa.array(out, type=pa.binary()).cast(pa.string())

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return tx.map_texts(rows, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_runs, the longest run's start, length, period and exponent_milli,
    runs_sha256, collapsed_sha256.

    The longest run is the one of greatest length, then smallest start, then period; without a
    run the four are null.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = find(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
