"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score of a text is w0 + sum w_i x_i + half of sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2):
all pairwise interactions in time linear in the features. It is trained with Adagrad on a
bounded sample of labelled texts; scoring runs over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.llm import text as tx

#: Buckets of hashed words, rank of the interactions.
BUCKETS, RANK = 4096, 8
#: Labelled texts used for training, those with the least hash of their id; the rest of the
#: labelled rows is not read. A text has at most BUCKETS features, so the sample is bounded.
SAMPLE = 4000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.1, 1e-5, 11
THRESHOLD = 0.3
#: Ids whose checksum leaves this remainder are held out from training.
FOLDS, HELD_OUT = 5, 0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>^~=+\\/", "bar": b"|",
    "shout": b"!?", "stop": b".", "comma": b",;:", "line": b"\n", "blank": b" \t", "high": range(128, 256), "quote": b"\"'()[]{}",
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k
STATISTICS = len(_CLASSES) + 6


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text is 0 modulo 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse word features (columns, values, first of each text) and dense statistics.

    Word values are log counts scaled to length one. Statistics are shares of byte classes,
    log numbers of words and characters, mean word length, the share of distinct words, that of
    the commonest one, and that of words that repeat the word before.
    """
    n = len(texts)
    words = tx.Words(texts)
    counts = np.diff(words.first)
    text_of = np.repeat(np.arange(n), counts)
    bucket = (words.hashes >> np.uint64(52)).astype(np.int64)
    cells, times = np.unique(text_of * BUCKETS + bucket, return_counts=True)
    owner, columns = cells // BUCKETS, cells % BUCKETS
    first = np.searchsorted(owner, np.arange(n + 1))
    values = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, values * values, n))
    values = values / np.maximum(norm, 1e-9)[owner]

    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    of = np.repeat(np.arange(n), sizes)
    shares = np.bincount(of * (len(_CLASSES) + 1) + _CLASS_OF[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, :-1]
    dense = np.zeros((n, STATISTICS))
    dense[:, : len(_CLASSES)] = shares / np.maximum(sizes, 1)[:, None]
    some = np.maximum(counts, 1)
    letters = np.bincount(text_of, (words.stops - words.starts).astype(float), n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    same = np.zeros(len(bucket), dtype=float)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    dense[:, -6:] = np.stack(
        [np.log1p(counts) / 5, np.log1p(sizes) / 5, letters / some / 10, np.diff(first) / some, top / some, np.bincount(text_of, same, n) / some], axis=1
    )
    return columns, values, first, dense


@dataclass
class Machine:
    """A trained factorisation machine; columns from BUCKETS on are the scaled statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def rows(self, columns, values, first, dense):
        """All features of each text as one sparse matrix: words, then statistics."""
        n = len(first) - 1
        scaled = np.clip((dense - self.middle) / self.spread, -3, 3) / 3
        counts = np.diff(first)
        out_first = first + np.arange(n + 1) * STATISTICS
        cols = np.empty(out_first[-1], dtype=np.int64)
        vals = np.empty(out_first[-1])
        at = np.arange(len(columns)) + np.repeat(np.arange(n) * STATISTICS, counts)
        cols[at], vals[at] = columns, values
        tail = (out_first[1:, None] - STATISTICS + np.arange(STATISTICS)).ravel()
        cols[tail] = np.tile(BUCKETS + np.arange(STATISTICS), n)
        vals[tail] = scaled.ravel()
        return cols, vals, out_first

    def raw(self, cols, vals, first):
        """Scores before the logistic, and the sums that training needs."""
        weighted = self.factors[cols] * vals[:, None]
        sums = np.add.reduceat(weighted, first[:-1], axis=0)
        squares = np.add.reduceat(weighted * weighted, first[:-1], axis=0)
        linear = np.add.reduceat(self.weights[cols] * vals, first[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        cols, vals, first = self.rows(*features(texts))
        return 1 / (1 + np.exp(-np.clip(self.raw(cols, vals, first)[0], -30, 30)))


def train(columns, values, first, dense, target, seed: int = SEED) -> Machine:
    """Adagrad on the logistic loss, in batches of a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), dense.mean(axis=0), dense.std(axis=0) + 1e-6)
    cols, vals, starts = machine.rows(columns, values, first, dense)
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            lengths = starts[pick + 1] - starts[pick]
            at = np.concatenate([[0], np.cumsum(lengths)])
            idx = np.repeat(starts[pick] - at[:-1], lengths) + np.arange(at[-1])
            c, v = cols[idx], vals[idx]
            raw, sums = machine.raw(c, v, at)
            error = (1 / (1 + np.exp(-raw)) - target[pick]) / len(pick)
            each = np.repeat(error, lengths) * v
            grad_v = each[:, None] * (np.repeat(sums, lengths, axis=0) - machine.factors[c] * v[:, None])
            touched, back = np.unique(c, return_inverse=True)
            gw = np.bincount(back, each) + DECAY * machine.weights[touched]
            gv = np.stack([np.bincount(back, grad_v[:, f]) for f in range(RANK)], axis=1) + DECAY * machine.factors[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            seen_b += error.sum() ** 2
            machine.weights[touched] -= RATE * gw / np.sqrt(seen_w[touched])
            machine.factors[touched] -= 0.3 * RATE * gv / np.sqrt(seen_v[touched])
            machine.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return machine


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | float:
    """The machine of a bounded sample of labelled texts that aren't held out.

    Several labels of a document count as its least one. Without both classes there is nothing
    to learn: the score of every text is then the share of label 1, or 0.5 without labels.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("target"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(picked, F.col("id") == F.col("doc_id")).select("text", "target")

    def fn(batch, data):
        columns, values, first, dense = features(data)
        cut = lambda x: [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        return batch.column("target"), cut(columns.astype(np.int32)), cut(values.astype(np.float32)), list(dense)

    got = tx.map_texts(texts, fn, "target int, columns array<int>, values array<float>, dense array<double>").toPandas()
    target = got["target"].to_numpy(dtype=float)
    if len(set(target)) < 2:
        return float(target.mean()) if len(target) else 0.5
    # Rows arrive in any order; a fixed one makes training repeatable.
    got = got.iloc[np.lexsort([[float(d[i]) for d in got["dense"]] for i in range(STATISTICS)])]
    first = np.concatenate([[0], np.cumsum([len(c) for c in got["columns"]])])
    flat = lambda name, kind: np.concatenate([np.asarray(x, dtype=kind) for x in got[name]])
    return train(flat("columns", np.int64), flat("values", float), first, np.stack(got["dense"]), got["target"].to_numpy(dtype=float))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the whole text is scored.

    Only the text enters a score. A null text counts as empty and is scored as one. Repeated
    rows score alike; an empty table gives an empty result. ``predicted`` is 1 from 0.3 on.
    """
    model = fit(docs, labels, sample)

    def fn(batch, texts):
        score = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
        return batch.column("doc_id"), score

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = tx.map_texts(rows, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
