"""Document fingerprints: min-hash signatures, their likeness, and bands that find alike ones.

A fingerprint holds the minima of many universal hash permutations over the five-word
shingles of a text, computed in numpy. Equal places estimate the Jaccard similarity; bands of
places are joined in Spark and the pairs they give are verified on full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepair.llm import minhash_dedup, set_join
from tidepair.llm import text as tx
from tidepair.session import stage

PERMUTATIONS, SEED = 128, 19
#: Bands and places in a band: a pair of similarity 0.75 shares a band with 1 - 4e-7.
BANDS, ROWS = 32, 4


def signatures(texts: list[bytes], n: int = PERMUTATIONS) -> np.ndarray:
    """One row of ``n`` 16-bit places a text; texts without words get all ones."""
    a, b = tx.permutations(n, SEED)
    return tx.minhash(*tx.Words(texts).shingles(), a, b).astype(np.uint16)


def written(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty."""

    def fn(batch, texts):
        return batch.column("doc_id"), written(signatures(texts))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return tx.map_texts(rows, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, mine binary, theirs binary, near_edited double, near_next double"


def _edited(text: str, following: str) -> bytes:
    """The text with its last third replaced by as many first characters of the next one."""
    cut = len(text) // 3
    return (text[: len(text) - cut] + following[:cut]).encode()


def _compared(ids: list, texts: list[bytes], followings: list[bytes], mine: np.ndarray, after: np.ndarray) -> list:
    """Columns of _COMPARED for texts with their successors and both signatures."""
    whole = [t.decode() for t in texts]
    edits = [_edited(t, f.decode()) for t, f in zip(whole, followings, strict=True)]
    theirs = _signed(edits)
    binary = lambda rows: [r.astype(">u2").tobytes() for r in rows]
    digests = [hashlib.sha256(e).hexdigest() for e in edits]
    return [ids, [len(t) for t in whole], digests, binary(mine), binary(theirs), (mine == theirs).mean(axis=1), (mine == after).mean(axis=1)]


def _signed(texts: list[bytes]) -> np.ndarray:
    """Signatures of many texts, hashed in slices of bounded size."""
    parts = [signatures(texts[a:b]) for a, b in tx.slices([len(t) for t in texts])]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), dtype=np.uint16)


def _stream(batches):
    """Compares each row of a sorted partition with the next one; the partition's first and
    last rows go out with their texts (kind F and L), to be linked across partitions."""
    schema = pa.schema(
        [("kind", pa.string()), ("digest", pa.string()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
        + [("mine", pa.binary()), ("theirs", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def border(kind, row):
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, (kind, row[1], row[2].decode(), row[0], *[None] * 6), strict=True)}, schema=schema)

    last, signed = None, None
    for batch in batches:
        texts, ids, digests = tx.text_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
        for a, b in tx.slices([len(t) for t in texts]):
            mine = signatures(texts[a:b])
            if last is None:
                yield border("F", (ids[a], digests[a], texts[a]))
                rows, signs = texts[a:b], mine
                owners = ids[a:b]
            else:
                rows, signs, owners = [last[2], *texts[a:b]], np.concatenate([signed, mine]), [last[0], *ids[a:b]]
            if len(rows) > 1:
                out = _compared(owners[:-1], rows[:-1], rows[1:], signs[:-1], signs[1:])
                n = len(rows) - 1
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string())] * 3 + [pa.array(c, type=schema.field(i + 3).type) for i, c in enumerate(out)], schema=schema)
            last, signed = (ids[b - 1], digests[b - 1], texts[b - 1]), mine[-1:]
    if last is not None:
        yield border("L", last)


def _across(borders: DataFrame) -> DataFrame:
    """The last row of each partition, compared with the first one of the next.

    Only ids and digests are put in order, two rows a partition; the texts are joined after.
    """
    order = Window.orderBy(F.col("doc_id").desc_nulls_last(), F.col("digest"), F.col("kind"))
    names = borders.select("kind", "doc_id", "digest", F.struct("doc_id", "digest").alias("name"))
    placed = names.withColumn("next", F.lead("name").over(order)).withColumn("start", F.first("name").over(order))
    lasts = placed.where("kind = 'L'").select("doc_id", "digest", F.coalesce("next", "start").alias("next"))
    key = lambda doc_id, digest: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), digest)
    texts = borders.select(key(F.col("doc_id"), F.col("digest")).alias("key"), "text").dropDuplicates(["key"])
    wanted = lasts.select("doc_id", key(F.col("doc_id"), F.col("digest")).alias("own"), key(F.col("next.doc_id"), F.col("next.digest")).alias("after"))
    pairs = wanted.join(texts.select(F.col("key").alias("own"), "text"), "own").join(texts.select(F.col("key").alias("after"), F.col("text").alias("following")), "after")

    def fn(batch, texts):
        following = tx.text_bytes(batch.column("following"))
        return _compared(batch.column("doc_id").to_pylist(), texts, following, signatures(texts), _signed(following))

    return tx.map_texts(pairs.select("doc_id", "text", "following"), fn, _COMPARED)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, of its edited text, and their likenesses.

    The edited text has its last third replaced by the beginning of the next document, by
    descending doc_id (after the last comes the first). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty; null
    ids come last; rows of one id follow each other in order of their texts' digests; a lone
    document follows itself. An empty table gives an empty result.

    Texts are dealt once, by ranges of ids; a partition streams through its sorted rows with
    the last one in hand, and only rows at the borders of partitions are joined.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = stage(dealt.mapInArrow(_stream, f"kind string, digest string, text string, {_COMPARED}"), "fingerprints")
    done = streamed.where("kind is null").select(*[c.split(" ")[0] for c in _COMPARED.split(", ")])
    every = done.unionByName(_across(streamed.where("kind is not null").select("kind", "doc_id", "digest", "text")))
    hexed = lambda c: F.lower(F.hex(c))
    return every.select("doc_id", "n_chars", "edited_sha256", hexed("mine").alias("fingerprint"), hexed("theirs").alias("edited_fingerprint"), "near_edited", "near_next")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of documents that the bands link: verified pairs and their classes.

    Signatures fall into bands; any two documents that share a band and whose full sets have a
    Jaccard similarity of 0.75 or more end in one class. Texts
    with equal sets are merged first. ``class_id`` is the least doc_id reachable. Rows without
    an id or without words are left out; an empty table gives an empty result.
    """
    a, b = tx.permutations(BANDS * ROWS, SEED)

    def fn(batch, texts):
        sets, first = tx.distinct(*tx.Words(texts).shingles())
        sig = tx.minhash(sets, first, a, b).view(np.int32)
        digests = [set_join.set_digest(sets[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
        flat = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32), pa.array(sig.ravel()))
        return batch.column("doc_id"), np.diff(first), digests, flat

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stage(tx.map_texts(rows, fn, "doc_id long, size long, digest binary, sig array<int>").where("size > 0"), "signatures")
    classes = stage(sketch.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("sig").alias("sig")), "classes")
    band = lambda i: F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS))
    keys = classes.select("node", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key"))
    met = stage(minhash_dedup.buckets(keys), "buckets")
    found = minhash_dedup.link(met, classes, rows, BANDS * ROWS // 2)
    named = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    return sketch.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
