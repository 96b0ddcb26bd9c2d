"""Near-duplicates by MinHash with tensored tables, confirmed on full shingle sets.

Two small collections of min-hash groups are computed for each text; every table key joins a
group of the first collection with one of the second. So 12 + 12 groups of two hashes make
144 tables of four hashes from 48 hashes instead of 576. A pair of similarity 0.75 meets in a
table unless all 12 groups of a collection differ: 1 - 2 * 0.4375 ** 12 = 0.9999.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.llm import set_join
from tidepair.llm import text as tx
from tidepair.llm.graph import components
from tidepair.session import stage

#: Groups in each of the two collections, and hashes in a group.
GROUPS, WIDTH = 12, 2
SEED = 7
#: A candidate needs this many equal hashes of 48; a pair of similarity 0.75 has 36 on average.
LEAST_EQUAL = 18
#: Similarity of a link, in per cent.
PERCENT = 75


def sketches(docs: DataFrame, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every row; a null text has no shingles.

    ``digest`` names the whole shingle set (128 bits), ``sig`` holds 2 * groups * width minima.
    """
    a, b = tx.permutations(2 * groups * width, SEED)

    def fn(batch, texts):
        sets, first = tx.distinct(*tx.Words(texts).shingles())
        sig = tx.minhash(sets, first, a, b).view(np.int32)
        digests = [set_join.set_digest(sets[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
        flat = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32), pa.array(sig.ravel()))
        return batch.column("doc_id"), np.diff(first), digests, flat

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return tx.map_texts(docs, fn, "doc_id long, n_shingles long, digest binary, sig array<int>")


def table_keys(sketch: DataFrame, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """(key, node): one row per node and pair of groups, one from each collection."""
    part = lambda at: [F.get("sig", at * width + k) for k in range(width)]
    first = F.array(*[F.xxhash64(F.lit(i), *part(F.lit(i))) for i in range(groups)])
    second = F.array(*[F.xxhash64(F.lit(i), *part(F.lit(groups + i))) for i in range(groups)])
    wide = sketch.select("node", first.alias("x"), second.alias("y"))
    wide = wide.select("node", "y", F.explode("x").alias("x"))
    return wide.select("node", "x", F.explode("y").alias("y")).select(F.xxhash64("x", "y").alias("key"), "node")


def buckets(keys: DataFrame) -> DataFrame:
    """(key, node, lo, hi, n) of buckets with several nodes: their least and greatest one, and how many.

    The ends of a bucket come from a map-side aggregate; the join back is one that Spark can
    split at a hot key.
    """
    ends = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("node").alias("n")).where("lo < hi")
    return keys.join(ends, "key")


def candidates(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: every node with the least node of all its tables' buckets.

    So a node gives one pair at first, however large its groups are; ``link`` sees to the others.
    """
    return _least_ends(buckets(keys))


def _least_ends(met: DataFrame) -> DataFrame:
    return met.groupBy("node").agg(F.min("lo").alias("a")).where("a < node").select("a", F.col("node").alias("b"))


def likely(pairs: DataFrame, sketch: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` places or more."""
    one = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    two = one.join(sketch.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return two.where(equal >= least).select("a", "b").distinct()


def link(met: DataFrame, classes: DataFrame, docs: DataFrame, least: int, percent: int = PERCENT) -> DataFrame:
    """(node, component) such that any two nodes of one bucket that are similar are in one component.

    ``met`` holds the buckets (key, node, lo), ``classes`` their (node, digest, sig). First every
    node is verified against the least node that it shares a bucket with; copies of one text end
    in one component by a comparison each. Buckets that still hold several components are
    open: their nodes are joined by the rare members of their sets, which misses no similar pair
    and makes few others, and what is found is verified.
    """
    sets = stage(set_join.sets_of(docs, classes.join(met.select("node"), "node", "left_semi")), "sets")
    near = likely(_least_ends(met), classes.select("node", "sig"), least)
    links = stage(set_join.verified(near, sets, percent), "links")
    label = stage(components(links), "components")
    rows = met.select("key", "node").join(label.repartition(F.xxhash64("node")), "node", "left")
    rows = rows.select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one < two")
    open_ = rows.join(mixed.select("key").repartition(F.xxhash64("key")), "key", "left_semi").groupBy("node").agg(F.any_value("component").alias("component"))
    left = stage(sets.join(open_, "node"), "open")
    pairs = stage(set_join.across(left, percent), "pairs")
    more = stage(set_join.verified(pairs, sets, percent), "links")
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, groups: int = GROUPS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, n_shingles, component_id, kept), one row per row.

    A text's set holds its distinct five-word shingles, lower-cased in A-Z; with fewer words the
    whole sequence is one; a null or blank text has an empty set and is linked with nothing.
    Texts with equal sets are merged before tables are built, so exact copies add no pairs.
    ``component_id`` is the least doc_id reachable, ``kept`` marks that document. Rows without a
    doc_id count as copies of no one: component_id is null and kept false. Rows that repeat a
    doc_id are texts of one document. An empty table gives an empty result.
    """
    sketch = stage(sketches(docs, groups, width), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("sig").alias("sig")), "classes")
    met = stage(buckets(table_keys(classes.select("node", "sig"), groups, width)), "buckets")
    found = link(met, classes, docs, LEAST_EQUAL, percent)
    named = classes.select("digest", "node").join(found, "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("component"))
    out = sketch.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; columns stay as they are.

    Rows without a doc_id can't be named by a group and stay; of rows that repeat a kept doc_id
    one stays.
    """
    key = tx.fresh(docs, "_kept_id")
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(key)).distinct()
    chosen = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id").cast("long") == F.col(key), "left_semi")
    return chosen.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
