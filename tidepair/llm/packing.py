"""Packing documents into sequences of fixed length, each near the target mixture of sources.

Sources are queues that take turns by deficit round-robin. A window is one sequence long; with
every window a queue's credit grows by its share of it, and once the credit is a turn's worth
(``TURN`` tokens) the queue serves that many. A turn ends where the queue's total reaches what it
has been credited, so a document is cut there unless the cut would leave a splinter; what a turn
serves too much or too little stays in the credit, whichever window and partition the next turn
falls into. As credits are linear in the window's number, turn and window of a token follow from
its place in its queue: a running sum over small counts, not a walk through the corpus.

Windows are dealt to partitions in bins of ``BIN`` neighbours; in a bin turns are one stream, cut
every 4096 tokens. The rest at a bin's end becomes sequences of powers of two, without padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepair.llm import text as tx
from tidepair.session import stage

VOCABULARY = "word_bpe_49k.json"
#: The id behind every document.
END = 2
#: Tokens of a sequence.
LENGTH = 4096
#: Least tokens of a turn, and least tokens that a cut may leave of a document: shorter turns keep each
#: window nearer to the mixture, longer ones cut fewer documents.
TURN, SPLINTER = 128, 32
#: Windows whose turns are packed as one stream.
BIN = 1024
#: Pieces of up to so many characters are kept with their ids, up to so many of them.
LONGEST_KEPT, MOST_KEPT = 64, 700_000
#: Pieces that go to the tokenizer as one text.
TOGETHER = 256


#: White space, and plain code points: ASCII and the Latin letters that stand for themselves after
#: normalisation and have one lower-case letter each.
_BLANK = r" \t-\r"
_PLAIN = r"\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01c3\u01cd-\u01ef"
_LETTERS = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01c3\u01cd-\u01ef"
_SUFFIXES = "'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]"
_PIECES = rf"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^{_BLANK}0-9{_LETTERS}]+"
#: Pieces of a plain text; pieces of any text, where a word with another code point is one piece.
_PLAIN_PIECES = re.compile(_PIECES)
_ANY_PIECES = re.compile(rf"(?<![^{_BLANK}])[^{_BLANK}]*[^{_PLAIN}][^{_BLANK}]*|{_PIECES}")
_OTHER = re.compile(rf"[^{_PLAIN}]")


class WordIds:
    """Ids of texts by a tokenizer that splits words at white space and drops it.

    Its pattern takes letters, single digits, other signs and the English suffixes apart, so the
    ids of a text are those of its pieces in a row, and ids of short pieces are kept. Pieces of
    plain letters, digits or signs go to the tokenizer in batches, joined by blanks: each gives
    ids up to one that ends a word. A word with any other code point goes there by itself. Ids
    are bytes: two a token, little-endian, or four if the vocabulary is larger.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, plain: list[str], alone: list[str]) -> None:
        """Keep the ids of pieces: ``plain`` ones hold plain letters, one digit or plain signs alone."""
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(group):
                alone = alone + group
                continue
            data, width = ids.tobytes(), self.kind.itemsize
            self.kept.update((p, data[a * width : b * width]) for p, a, b in zip(group, [0, *ends[:-1]], ends, strict=True))
        self.kept.update((p, ids.tobytes()) for p, ids in zip(alone, self._ids(alone), strict=True))

    def encode(self, texts: list[bytes], end: int = END) -> list[bytes]:
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        split, plain, odd = [], set(), set()
        for data in texts:
            text = data.decode()
            if _OTHER.search(text):
                split.append(_ANY_PIECES.findall(text))
                odd.update(split[-1])
            else:
                split.append(_PLAIN_PIECES.findall(text.lower()))
                plain.update(split[-1])
        alone = {p for p in odd.difference(self.kept) if _OTHER.search(p)}
        missing = list(plain.union(odd).difference(self.kept, alone))
        self.learn(missing, list(alone))
        last = np.array([end], dtype=self.kind).tobytes()
        get = self.kept.__getitem__
        out = [b"".join(map(get, own)) + last for own in split]
        for p in chain(missing, alone):
            if len(p) > LONGEST_KEPT:
                del self.kept[p]
        return out


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of a vocabulary file, made once a process."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, queue, ids, width, n_tokens, task, before) of every row.

    ``queue`` names the source (null is a queue of its own), ``ids`` holds ``width`` bytes a token;
    ``before`` counts the tokens of the queue that this task met earlier. Only a written copy of
    this frame is used, so that the places don't change when an executor is lost.
    """

    def fn(batch, texts):
        tokenizer, task = word_ids(path), TaskContext.get().partitionId()
        width = tokenizer.kind.itemsize
        ids = tokenizer.encode(texts, end)
        counts, queues, before = [len(x) // width for x in ids], batch.column("queue"), []
        for queue, n in zip(queues.to_pylist(), counts, strict=True):
            before.append(served[task, queue])
            served[task, queue] += n
        return batch.column("doc_id"), queues, ids, [width] * len(ids), counts, [task] * len(ids), before

    served: dict = defaultdict(int)
    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("queue"), F.col("text").cast("string").alias("text"))
    return tx.map_texts(rows, fn, "doc_id long, queue string, ids binary, width int, n_tokens long, task int, before long")


def quanta(cells: DataFrame, weights: dict[str | None, float] | None = None, length: int = LENGTH, turn: int = TURN) -> DataFrame:
    """(queue, every, quantum): a queue serves ``quantum`` tokens in each ``every``-th window.

    Only the sum of the weights comes to the driver.

    Without ``weights`` a queue's share is its share of all tokens, so that all queues end
    together. With weights by source (others: none) shares follow them; queues that end early
    leave their part to the others. A queue without weight shares as if it had the least one given.
    """
    sums = cells.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    if weights is None:
        weight = F.col("tokens").cast("double")
    else:
        fine = {("" if k is None else "=" + k): float(w) for k, w in weights.items() if w > 0}
        weight = F.lit(min(fine.values(), default=1.0))
        for queue, w in fine.items():
            weight = F.when(F.col("queue") == queue, w).otherwise(weight)
    sums = sums.select("queue", weight.alias("weight"))
    total = sums.agg(F.sum("weight")).first()[0] or 1.0
    rate = F.lit(length / total) * F.col("weight")
    every = F.greatest(F.ceil(F.lit(float(turn)) / rate), F.lit(1)).cast("long")
    return sums.select("queue", every.alias("every"), (rate * every).alias("quantum"))


def turns(tokens: DataFrame, weights: dict[str | None, float] | None = None, length: int = LENGTH, turn: int = TURN, splinter: int = SPLINTER) -> DataFrame:
    """(window, queue, place, doc_id, start, length, doc_tokens, width, ids): the pieces of all documents.

    ``place`` is where the piece begins in its queue: tasks in their order, documents as met.
    """
    cells = stage(tokens.groupBy("task", "queue").agg(F.sum("n_tokens").alias("tokens")), "cells")
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("task", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    bases = bases.join(quanta(cells, weights, length, turn), "queue")
    rows = tokens.join(stage(bases, "bases"), ["task", "queue"])
    at, n = F.col("base") + F.col("before"), F.col("n_tokens")
    rows = rows.select("queue", "doc_id", "ids", "width", "n_tokens", "every", "quantum", at.alias("at"))

    def inside(k):
        """Where turn k begins within the document: its cut, moved off splinters."""
        cut = F.ceil(k * F.col("quantum")) - F.col("at")
        return F.when(cut < splinter, F.lit(0)).when(cut > n - splinter, n).otherwise(cut).cast("long")

    first = F.floor(F.col("at") / F.col("quantum")) - 1
    last = F.floor((F.col("at") + n) / F.col("quantum")) + 1
    spans = F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("turn"), inside(k).alias("lo"), inside(k + 1).alias("hi")))
    rows = rows.withColumn("span", F.explode(F.filter(spans, lambda s: s["lo"] < s["hi"])))
    window = F.col("span.turn") * F.col("every") + F.pmod(F.xxhash64("queue"), F.col("every"))
    piece = F.substring("ids", F.col("span.lo") * F.col("width") + 1, (F.col("span.hi") - F.col("span.lo")) * F.col("width"))
    return rows.select(
        F.greatest(window, F.lit(0)).alias("window"),
        "queue",
        (F.col("at") + F.col("span.lo")).alias("place"),
        "doc_id",
        F.col("span.lo").alias("start"),
        (F.col("span.hi") - F.col("span.lo")).alias("length"),
        F.col("n_tokens").alias("doc_tokens"),
        "width",
        piece.alias("ids"),
    )


class _Filler:
    """The stream of one bin: full sequences go out as soon as they are full."""

    def __init__(self, bin_: int, length: int):
        self.bin, self.length, self.number = bin_, length, 0
        self.held: list[tuple] = []
        self.size = 0

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray):
        while len(ids):
            part = ids[: self.length - self.size]
            self.held.append((doc_id, start, doc_tokens, part))
            self.size += len(part)
            start, ids = start + len(part), ids[len(part) :]
            if self.size == self.length:
                yield from self.leave(self.held)
                self.held, self.size = [], 0

    def leave(self, pieces: list[tuple]):
        offset, sequence = 0, (self.bin << 32) + self.number
        self.number += 1
        for doc_id, start, doc_tokens, ids in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset, ids
            offset += len(ids)

    def finish(self):
        """The rest as sequences of powers of two, longest first."""
        rest, size = self.held, self.size
        while size:
            take, own = 1 << (size.bit_length() - 1), []
            size -= take
            while take:
                doc_id, start, doc_tokens, ids = rest.pop(0)
                own.append((doc_id, start, doc_tokens, ids[:take]))
                if len(ids) > take:
                    rest.insert(0, (doc_id, start + take, doc_tokens, ids[take:]))
                take -= len(own[-1][3])
            yield from self.leave(own)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(pieces: DataFrame, length: int = LENGTH, bin_: int = BIN, keep_ids: bool = True) -> DataFrame:
    """Pieces of turns as pieces of sequences: bins are dealt out, each one's stream is cut every ``length`` tokens."""
    names = PACKED + (", ids array<int>" if keep_ids else "")
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
    columns = [c.split()[0] for c in names.split(", ")]
    schema = pa.schema([pa.field(c, k) for c, k in zip(columns, kinds, strict=True)])

    def batch_of(rows):
        *plain, ids = zip(*rows, strict=True)
        arrays = [pa.array(c, type=pa.int64()) for c in plain]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        filler, out = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                bins, docs, starts, counts, widths, ids = (part.column(c).to_pylist() for c in ("bin", "doc_id", "start", "doc_tokens", "width", "ids"))
                for b, doc_id, start, n, width, data in zip(bins, docs, starts, counts, widths, ids, strict=True):
                    if filler is None or filler.bin != b:
                        if filler:
                            out += filler.finish()
                        filler = _Filler(b, length)
                    out += filler.add(doc_id, start, n, np.frombuffer(data, dtype=f"<u{width}"))
                if out:
                    yield batch_of(out)
                    out = []
        if filler:
            out += filler.finish()
        if out:
            yield batch_of(out)

    dealt = pieces.withColumn("bin", F.floor(F.col("window") / bin_)).repartition("bin").sortWithinPartitions("bin", "window", "queue", "place")
    return dealt.select("bin", "doc_id", "start", "doc_tokens", "width", "ids").mapInArrow(run, names)


def pack(docs: DataFrame, path: str | None = None, weights: dict[str | None, float] | None = None, keep_ids: bool = True, length: int = LENGTH) -> DataFrame:
    """All documents in sequences of at most ``length`` tokens: one row a piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): tokens ``start`` to
    ``start + length`` of the document (its ids and ``END``) stand at ``offset`` of the sequence.
    Every token lies in exactly one piece, every sequence is filled from 0 without gaps; those
    shorter than ``length`` have a power of two. A null or blank text is ``END`` alone; rows that
    repeat a doc_id, or have none, are documents of their own; a null source is a source.
    ``weights`` gives shares by source, the corpus's own by default. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    tokens = stage(tokenize(docs, path), "tokens")
    return fill(turns(tokens, weights, length, min(TURN, length), min(SPLINTER, length // 2)), length, keep_ids=keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ids; a sequence is bounded by its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
