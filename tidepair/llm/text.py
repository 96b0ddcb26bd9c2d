"""Vectorised word and shingle hashing for Arrow batches of texts.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D; those bytes never occur
inside a multi-byte UTF-8 character, so byte words are text words. Hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Texts are hashed in slices of about this many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 2_000_000

_U = np.uint64
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 21), _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return _powers[kind][:n]


def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in bytes that end with a blank."""
    edge = np.flatnonzero(np.diff(_IS_SPACE[data], prepend=True))
    return edge[0::2], edge[1::2]


class Words:
    """Word hashes of several texts: ``hashes[first[i]:first[i + 1]]`` belong to text i."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        # One blank after each text keeps words of neighbours apart.
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        self.starts, self.stops = edges(data)
        summed = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * _power("up", len(data)), out=summed[1:])
        raw = (summed[self.stops] - summed[self.starts]) * _power("down", len(data))[self.starts]
        self.hashes = mix(raw + (self.stops - self.starts).astype(np.uint64))
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)])

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words in text order, and the first one of each text.

        A text with fewer words is one window; a text without words has none.
        """
        w, first = self.hashes, self.first
        counts = np.diff(first)
        out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
        out_first = np.concatenate([[0], np.cumsum(out_counts)])
        n = max(0, len(w) - size + 1)
        whole = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            whole += w[k : n + k] * _PLACE[k]
        text_of = np.repeat(np.arange(len(counts)), out_counts)
        at = np.arange(out_first[-1]) - out_first[text_of] + first[text_of]
        short = counts[text_of] < size
        out = np.zeros(len(at), dtype=np.uint64)
        out[~short] = whole[at[~short]]
        for i in np.flatnonzero(short):
            words = w[at[i] : at[i] + counts[text_of[i]]]
            out[i] = (words * _PLACE[: len(words)]).sum(dtype=np.uint64) + _U(len(words))
        return mix(out), out_first


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        s = np.sort(hashes[a:b])
        sets.append(s[np.diff(s, prepend=s[:1] - _U(1)) != 0] if b - a > 1 else s)
    sizes = np.cumsum([len(s) for s in sets]) if sets else np.zeros(0, dtype=np.int64)
    return (np.concatenate(sets) if sets else hashes[:0]), np.concatenate([[0], sizes]).astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both, len(a) + len(b) - both


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of ``n`` universal hash functions x -> (a x + b) >> 32 on 64 bits."""
    rng = np.random.default_rng(seed)
    return (
        rng.integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1),
        rng.integers(0, 2**63, n, dtype=np.uint64) * _U(2),
    )


def minhash(hashes: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima per text; texts without shingles get the largest value."""
    counts = np.diff(first)
    out = np.full((len(counts), len(a)), 2**32 - 1, dtype=np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        at = first[:-1][full]
        for j in range(len(a)):
            out[full, j] = np.minimum.reduceat((hashes * a[j] + b[j]) >> _U(32), at)
    return out


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``limit`` bytes; a longer row is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, fn, schema: str, text: str = "text") -> DataFrame:
    """Run ``fn(record_batch, texts as bytes)`` over slices of bounded size; it returns columns.

    ``fn`` gives one list or array for each output column, all of one length.
    """
    target = T._parse_datatype_string(schema)
    fields = [(f.name, f.dataType) for f in target.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in fields])
        for batch in batches:
            sizes = batch.column(text).cast(pa.binary()).fill_null(b"")
            sizes = pa.compute.binary_length(sizes).to_pylist()
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                columns = fn(part, text_bytes(part.column(text)))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)],
                    schema=kinds,
                )

    return df.mapInArrow(run, target)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text="text"):
    """Number of words of a text column; a null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
