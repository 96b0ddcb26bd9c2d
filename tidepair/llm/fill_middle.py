"""Fill-in-the-middle by secondary sort: pieces of whole units, dealt by document, sorted by place.

A text is cut into units (runs of ASCII letters, else one code point each); a keyed hash of the
id picks two cuts and the form. Nothing is assembled where it is cut: each segment leaves as
pieces of at most ``CHUNK`` units under (document, output place). Dealing pieces by document and
sorting inside each partition (repartitionAndSortWithinPartitions, in its DataFrame form) makes
the output a stream, read piece by piece into a digest. The stream is parsed as any reader of
the output would parse it, from its form and its marks; parsed pieces get their place in the
original and are sorted again inside the same partition, without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepair.llm import text as tx

#: Marks before prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that are cut at all, and of those the per cent that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1
#: Most units, and most bytes, of one piece.
CHUNK, CHUNK_BYTES = 4096, 65_536
#: Bytes of pieces in one Arrow batch.
BATCH_BYTES = 2_000_000
#: Segments of an output by form, in output order; the original order is prefix, middle, suffix.
ORDERS = {"plain": (b"",), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_ORIGINAL = {b"": 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_SPREAD = 1 << 40

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

PIECE = "doc_id long, digest binary, copy int, place long, piece string, n long, form string, prefix_chars long, middle_chars long"
KEY = ["doc_id", "digest", "copy"]


def unit_starts(data: bytes) -> np.ndarray:
    """Byte places where units begin; a unit never parts a code point."""
    raw = np.frombuffer(data, dtype=np.uint8)
    letter = _LETTER[raw]
    inside = (raw & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def plan(doc_id: int | None, data: bytes, n: int, seed: int = SEED) -> tuple[str, int, int]:
    """(form, units before the middle, units before the suffix) of a text of ``n`` units."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    marked = any(m in data for m in (PREFIX, SUFFIX, MIDDLE))
    if not data or marked or h3 % 100 >= CUT:
        return "plain", 0, n
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SUFFIX_FIRST else "psm"), *cuts


def _segment(data: bytes, starts: np.ndarray, lo: int, hi: int) -> Iterator[bytes]:
    """Units lo to hi of a text in chunks; a unit longer than a piece is parted between letters."""
    at = lo
    while at < hi:
        end = min(at + CHUNK, hi)
        a, b = int(starts[at]), int(starts[end]) if end < len(starts) else len(data)
        for k in range(a, b, CHUNK_BYTES):
            cut = min(k + CHUNK_BYTES, b)
            yield data[_whole(data, a, k) : _whole(data, a, cut) if cut < b else b]
        at = end


def _whole(data: bytes, least: int, at: int) -> int:
    """The place ``at``, moved left to where a code point begins."""
    while at > least and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cut(doc_id: int | None, data: bytes, seed: int = SEED) -> tuple[int, str, int | None, int | None, list[bytes]]:
    """(n, form, prefix_chars, middle_chars, output pieces) of one text; the first piece is never missing."""
    starts = unit_starts(data)
    n = len(starts)
    form, first, second = plan(doc_id, data, n, seed)
    if form == "plain":
        return n, form, None, None, list(_segment(data, starts, 0, n)) or [b""]
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, n)}
    pieces = []
    for mark in ORDERS[form]:
        own = list(_segment(data, starts, *spans[mark])) or [b""]
        pieces += [mark + own[0], *own[1:]]
    raw = np.frombuffer(data, dtype=np.uint8)
    chars = [0, *np.cumsum([((raw[slice(*(int(starts[u]) if u < n else len(data) for u in spans[m]))] & 0xC0) != 0x80).sum() for m in (PREFIX, MIDDLE)])]
    return n, form, int(chars[1]), int(chars[2] - chars[1]), pieces


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_at: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; the bytes in column ``size_at`` bound each of them."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[size_at] or b"")
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for values, field in zip(zip(*rows, strict=True), schema, strict=True):
        kind = pa.binary() if pa.types.is_string(field.type) else field.type
        values = [v.encode() if isinstance(v, str) else v for v in values] if kind != field.type else list(values)
        columns.append(pa.array(values, type=kind).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _mapped(df: DataFrame, fn, schema: str, size_at: int) -> DataFrame:
    """``fn`` turns a stream of input rows into a stream of output rows, batch by batch."""
    target = T._parse_datatype_string(schema)

    def run(batches):
        yield from _batches(fn(_rows(batches)), to_arrow_schema(target), size_at)

    return df.mapInArrow(run, target)


def _rows(batches) -> Iterator[tuple]:
    """Rows of Arrow batches, a bounded number of bytes at a time; strings come as bytes."""
    for batch in batches:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in columns if pa.types.is_binary(c.type)]
        sizes = (64 + np.sum(lengths, axis=0)).tolist() if lengths else [64] * batch.num_rows
        for lo, hi in tx.slices(sizes, BATCH_BYTES):
            yield from zip(*[c.slice(lo, hi - lo).to_pylist() for c in columns], strict=True)


def pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Output pieces of every text, dealt by document and sorted by output place.

    One row a piece: (doc_id, digest, copy, place, piece) and, with the first piece of a document,
    (n, form, prefix_chars, middle_chars). ``digest`` is the MD5 of the text. Rows that repeat a
    doc_id and text are told apart by ``copy``, their number within the task that cuts them, so
    a row that repeats very often is dealt over many partitions; copies of different tasks give
    equal pieces under one key, and a reader counts those. A null text is an empty one; a null
    doc_id hashes as an empty text. Other columns are left out. An empty table gives no rows.
    """

    def fn(rows):
        seen = Counter()
        for doc_id, data in rows:
            data = data or b""
            digest = hashlib.md5(data, usedforsecurity=False).digest()
            copy = seen[doc_id, digest]
            seen[doc_id, digest] += 1
            n, form, prefix, middle, parts = cut(doc_id, data, seed)
            for place, piece in enumerate(parts):
                yield doc_id, digest, copy, place, piece, *((n, form, prefix, middle) if place == 0 else (None,) * 4)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(rows, fn, PIECE, 4).repartition(*KEY).sortWithinPartitions(*KEY, "place")


def _documents(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple[tuple, int]]]]:
    """Runs of sorted rows of one document, each with its distinct rows and how often they stand there."""
    rows = iter(rows)
    head = next(rows, None)
    while head is not None:
        key, pending = head[:width], [head]

        def distinct(key=key, pending=pending):
            row, times = pending[0], 1
            pending[0] = None
            for nxt in rows:
                if nxt[: width + 1] == row[: width + 1]:
                    times += 1
                    continue
                if nxt[:width] != key:
                    pending[0] = nxt
                    break
                yield row, times
                row, times = nxt, 1
            yield row, times

        own = distinct()
        yield key, own
        for _ in own:
            pass
        head = pending[0]


def parsed(form: str, stream: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(segment in the original, content) of the pieces of an output, read by its form and marks."""
    marks = list(ORDERS[form])
    segment, held = 0, b""
    for piece in stream:
        piece, held = held + piece, b""
        while True:
            nxt = marks[0] if marks else b""
            at = piece.find(nxt) if nxt else -1
            if at >= 0:
                if at:
                    yield segment, piece[:at]
                segment, piece = _ORIGINAL[nxt], piece[at + len(nxt) :]
                marks.pop(0)
                continue
            # The beginning of a mark may end a piece.
            keep = next((k for k in range(min(len(nxt) - 1, len(piece)), 0, -1) if piece.endswith(nxt[:k])), 0)
            held = piece[len(piece) - keep :]
            piece = piece[: len(piece) - keep]
            break
        if piece:
            yield segment, piece
    if held:
        yield segment, held


RESTORING = "doc_id long, digest binary, copy int, place long, piece string, times int, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"


def restoring(dealt: DataFrame) -> DataFrame:
    """The pieces of ``pieces`` without marks, sorted again by their place in the original.

    The stream of a document also goes into the digest of its output, which stands with
    (times, n, form, ...) in a last row of its own, without a piece. No row moves to another task.
    """

    def fn(rows):
        for key, own in _documents(rows, len(KEY)):
            state = {"sha": hashlib.sha256()}

            def stream(own=own, state=state):
                for row, times in own:
                    if row[3] == 0:
                        state |= {"head": row[5:], "times": times}
                    state["sha"].update(row[4])
                    yield row[4]

            pieces_ = stream()
            first = next(pieces_)
            form = state["head"][1].decode()

            def whole(first=first, rest=pieces_):
                yield first
                yield from rest

            counts = [0, 0, 0]
            for segment, content in parsed(form, whole()):
                yield *key, segment * _SPREAD + counts[segment], content, None, *(None,) * 5
                counts[segment] += 1
            yield *key, 3 * _SPREAD, None, state["times"], *state["head"], state["sha"].hexdigest()

    return _mapped(dealt, fn, RESTORING, 4).sortWithinPartitions(*KEY, "place")


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, exact), one row per row.

    ``exact`` tells that the restored text is the one that was cut. Null and empty texts have no
    units and stay plain; see ``pieces`` for null ids and repeated rows.
    """

    def fn(rows):
        for key, own in _documents(rows, len(KEY)):
            sha, md5 = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
            for row, _ in own:
                if row[4] is not None:
                    sha.update(row[4])
                    md5.update(row[4])
                    continue
                out = key[0], *row[6:], sha.hexdigest(), md5.digest() == key[1]
                for _ in range(row[5]):
                    yield out

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, exact boolean"
    return _mapped(restoring(pieces(docs, seed)), fn, schema, 6)


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the whole output texts, one row per row."""

    def fn(rows):
        for key, own in _documents(rows, len(KEY)):
            parts, head, many = [], None, 0
            for row, times in own:
                if row[3] == 0:
                    head, many = row[5:], times
                parts.append(row[4])
            for _ in range(many):
                yield key[0], *head, b"".join(parts)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return _mapped(pieces(docs, seed), fn, schema, 5)


def restore(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of rows with ``form`` and ``output``; a null form counts as plain, a null output as empty."""

    def fn(stream):
        for doc_id, form, output in stream:
            parts = ([], [], [])
            for segment, content in parsed((form or b"plain").decode(), iter([output or b""])):
                parts[segment].append(content)
            yield doc_id, b"".join(b"".join(p) for p in parts)

    return _mapped(rows.select("doc_id", "form", "output"), fn, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string", 1)
