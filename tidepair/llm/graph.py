"""Connected components of a link table, by alternating stars over small edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.session import stage


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (all larger, or all smaller and itself) to the least one."""
    both = _directed(edges) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    # Dealt by another hash, both sides of the join get an exchange that Spark can split.
    joined = both.join(least.repartition(F.xxhash64("_a")), F.col("a") == F.col("_a"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.where("_a <> m").select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links`` (a, b), for every node that has one.

    Each round halves long chains; stars are done after two. Rounds are written to the shared
    folder, so lineage stays short; only a count and a checksum come to the driver. A node
    with very many links is aggregated map-side and joined back by a skew-splittable join.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "links")
    seen = _stamp(edges)
    while seen[0]:
        edges = stage(_star(_star(edges, True), False), "stars")
        now = _stamp(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
