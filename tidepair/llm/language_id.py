"""Language identification in two steps: the family, then one against one within it.

A linear support vector machine for each family chooses the family; within it, one machine
for each pair of languages votes. Features are hashed byte trigrams and hashed words of the
lower-cased text, square-rooted and scaled to length one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepair.llm import text as tx

#: Hash buckets for trigrams and for words.
BUCKETS = 4096
#: Texts used a language for training: those with the least hash of their id. A text has at
#: most 2 * BUCKETS features, so the sample is bounded.
SAMPLE = 400
ROUNDS, RATE, DECAY = 300, 0.5, 1e-3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Families of related languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "mk", "pl", "cs", "sk", "sl", "hr"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text is 2 modulo 4; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of 2 * BUCKETS values a text."""
    n = len(texts)
    words = tx.Words(texts)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    out = np.empty((n, 2 * BUCKETS), dtype=np.float32)
    out[:, BUCKETS:] = np.bincount(owner * BUCKETS + (words.hashes >> np.uint64(52)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    of = np.repeat(np.arange(n), [len(t) for t in texts])
    grams = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(2654435761) >> np.uint32(20) if len(low) > 2 else low[:0]
    inside = of[2:] == of[:-2] if len(low) > 2 else of[:0].astype(bool)
    out[:, :BUCKETS] = np.bincount(of[: len(grams)][inside] * BUCKETS + grams[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    np.sqrt(out, out=out)
    for half in (out[:, :BUCKETS], out[:, BUCKETS:]):
        half /= np.maximum(np.sqrt((half * half).sum(axis=1)), 1e-6)[:, None]
    return out


def machine(rows: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """A linear machine (last weight: bias) by gradient steps on the squared hinge loss.

    Both sides weigh the same, whatever their numbers of rows.
    """
    weights, bias = np.zeros(rows.shape[1], dtype=np.float32), 0.0
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    for _ in range(ROUNDS):
        short = np.maximum(0, 1 - sign * (rows @ weights + bias)) * sign * share
        weights += RATE * (2 * (short @ rows) - DECAY * weights)
        bias += RATE * 2 * float(short.sum())
    return np.append(weights, np.float32(bias))


@dataclass
class Model:
    """Machines of the families and of the pairs within each."""

    families: list[str]
    family_weights: np.ndarray
    members: dict[str, list[str]]
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the surest family, then the most votes.

        The score is the logistic of the family's margin times that of the winner's smallest
        margin in its family. Ties in votes go to the larger sum of margins.
        """
        logistic = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -5, 5)))
        rows = features(texts)
        margins = rows @ self.family_weights[:, :-1].T + self.family_weights[:, -1] if len(self.families) > 1 else np.ones((len(texts), len(self.families)))
        chosen = margins.argmax(axis=1)
        against = {p: rows @ w[:-1] + w[-1] for p, w in self.pair_weights.items()}
        langs, scores = [], []
        for i, data in enumerate(texts):
            if not _LETTER.search(data.decode(errors="replace")):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            members = self.members[self.families[chosen[i]]]
            votes = {a: [float(against[a, b][i]) if (a, b) in against else -float(against[b, a][i]) for b in members if b != a] for a in members}
            best = max(members, key=lambda a: (sum(m > 0 for m in votes[a]), sum(votes[a])))
            langs.append(best)
            scores.append(float(logistic(margins[i, chosen[i]]) * logistic(min(votes[best], default=5.0))))
        return langs, scores


def train(rows: np.ndarray, langs: np.ndarray) -> Model:
    """All machines, from one feature row a text."""
    family = np.array([_FAMILY.get(x, x) for x in langs])
    names = sorted(set(family))
    one_against_rest = [machine(rows, np.where(family == f, 1, -1).astype(np.float32)) for f in names] if len(names) > 1 else []
    members = {f: sorted(set(langs[family == f])) for f in names}
    pairs = {}
    for f in names:
        for a, b in combinations(members[f], 2):
            at = np.flatnonzero((langs == a) | (langs == b))
            pairs[a, b] = machine(rows[at], np.where(langs[at] == a, 1, -1).astype(np.float32))
    weights = np.stack(one_against_rest) if one_against_rest else np.zeros((len(names), rows.shape[1] + 1), dtype=np.float32)
    return Model(names, weights, members, pairs)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of each language; None without any row to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.where(F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").cast("string").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select(F.col("doc_id").alias("id"), F.col("lang").alias("known")).distinct()
    texts = docs.join(picked, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("known")))

    def fn(batch, data):
        rows = features(data)
        at = [np.flatnonzero(r).astype(np.int32) for r in rows]
        return batch.column("id"), batch.column("known"), at, [r[a] for r, a in zip(rows, at, strict=True)]

    texts = texts.select(F.col("id").cast("string").alias("id"), "known", F.col("text").cast("string").alias("text"))
    got = tx.map_texts(texts, fn, "id string, known string, columns array<int>, values array<float>").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["id", "known"], kind="stable")  # rows arrive in any order
    rows = np.zeros((len(got), 2 * BUCKETS), dtype=np.float32)
    for i, (at, values) in enumerate(zip(got["columns"], got["values"], strict=True)):
        rows[i, at] = values
    return train(rows, got["known"].to_numpy(dtype=str))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the whole text is read.

    Only the text enters a prediction. A null text or one without letters is ``und`` with
    score 0; so is every text if there is nothing to learn from. Repeated rows get the same
    answer; an empty table gives an empty result.
    """
    model = fit(docs, sample)

    def fn(batch, texts):
        langs, scores = model.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return batch.column("doc_id"), langs, scores

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = tx.map_texts(rows, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
