"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshwright.plans.materialise import checkpoint, dealt


def _pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Each pair of different ends once, the larger first."""
    a, b = F.col(src), F.col(dst)
    return edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the node's least neighbour."""
    ways = _both_ways(pairs)
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    found = ways.filter(F.col("v") > F.col("u")).join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.filter("u != v")


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all get the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(dealt(least), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _checkpoint(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """pairs, written, and what tells one set of pairs from another, observed while they are written."""
    seen, mixed = Observation(), F.xxhash64("u", "v")
    state = F.count("*").alias("n"), F.sum(mixed.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mixed).alias("xor")
    return checkpoint(pairs.observe(seen, *state)), seen.get


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every end of an edge; component is the least node of its component.

    Direction doesn't matter, parallel edges and loops neither; a node whose only edges are loops is a component of its own.
    Stars need a number of steps that grows with the logarithm of the longest path, and no step gathers a node's
    neighbours, so a hub is split like any skewed join key.
    """
    # read three times
    edges = checkpoint(edges.select(src, dst))
    ends = edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node")))
    nodes = ends.filter(F.col("node").isNotNull()).distinct()
    pairs, before = _checkpoint(_pairs(edges, src, dst))
    while before["n"]:
        pairs, after = _checkpoint(_small_star(_large_star(pairs)))
        if after == before:
            break
        before = after
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(dealt(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
