"""Links between shingle sets: verification on staged hashes, and an exact join by rare prefixes.

Two sets of n and m members with similarity t share at least t (n + m) / (1 + t) of them. If
all members are ordered by rising frequency, such sets share one among the first few of each:
n - ceil(t n) + 1 of the larger, m - ceil(2 t m / (1 + t)) + 1 of the smaller. Members that one
set alone holds come first and take up places there, so a set that cannot reach t with any
other has nothing left to meet on; and where two sets meet, the places behind the meeting point
must still suffice. So what a frequent text has in common with all its variants builds no pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.llm import text as tx


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a whole set of sorted hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, hashes): the shingle set of each class (node, digest), from the text of its node."""

    def fn(batch, texts):
        sets, first = tx.distinct(*tx.Words(texts).shingles())
        digests = [set_digest(sets[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
        lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(sets.view(np.int64)))
        return batch.column("doc_id"), digests, np.diff(first), lists

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = rows.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    found = tx.map_texts(wanted, fn, "node long, digest binary, n int, hashes array<long>")
    # Rows that repeat an id may hold other texts.
    return found.join(classes.select("node", "digest"), ["node", "digest"], "left_semi").dropDuplicates(["node"]).select("node", "n", "hashes")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their sets.

    The node that stands in many pairs is joined last, in a join that Spark can split.
    """
    one = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    two = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    met = pairs.select("a", "b").join(one, "b").join(two, "a")
    both = F.size(F.array_intersect("h_a", "h_b"))
    met = met.select("a", "b", "n_a", "n_b", both.alias("both"))
    return met.where(F.lit(100) * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _ceil(over: str, by: int, into: int) -> F.Column:
    """``over`` * by / into, rounded up, in whole numbers."""
    return F.expr(f"({by}L * ({over}) + {into - 1}L) div {into}L")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component, n, h, place, indexed): the members on which a set can meet a similar one.

    ``place`` counts from 0 in the order of rising frequency among these sets; ``indexed`` members
    are those on which the set can be met as the smaller one. Members of one set alone take up
    places and are left out.
    """
    members = sets.select("node", F.explode("hashes").alias("h"))
    counts = members.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = members.join(counts.repartition(F.xxhash64("h")), "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "h"))).alias("shared"))
    rows = sets.select("node", "component", "n").join(shared, "node")
    first = F.col("n") - F.size("shared")
    probing = (F.col("n") - _ceil("n", percent, 100) + 1).cast("int")
    indexing = (F.col("n") - _ceil("n", 2 * percent, 100 + percent) + 1).cast("int")
    rows = rows.select("node", "component", "n", first.alias("first"), indexing.alias("indexing"), F.slice("shared", F.lit(1), F.greatest(probing - first, F.lit(0))).alias("shared"))
    rows = rows.select("node", "component", "n", "first", "indexing", F.posexplode("shared").alias("k", "m"))
    place = F.col("first") + F.col("k")
    return rows.select("node", "component", "n", F.col("m.h").alias("h"), place.alias("place"), (place < F.col("indexing")).alias("indexed"))


def across(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets (node, component, n, hashes) in different components that may be similar.

    No pair with 100 * intersection >= percent * union is missing; pairs still have to be verified.
    """
    rows = prefixes(sets, percent)
    larger = rows.select(*[F.col(c).alias(f"x_{c}") for c in ("node", "component", "n", "h", "place")])
    smaller = rows.where("indexed").select(*[F.col(c).alias(f"y_{c}") for c in ("node", "component", "n", "h", "place")])
    meet = [
        F.col("x_h") == F.col("y_h"),
        F.col("x_component") != F.col("y_component"),
        (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_node") < F.col("x_node"))),
        F.col("y_n") * 100 >= F.col("x_n") * percent,
        F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) >= _ceil("x_n + y_n", percent, 100 + percent),
    ]
    pairs = larger.join(smaller.repartition(F.xxhash64("y_h")), meet)
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
