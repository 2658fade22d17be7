"""Connected components of links, as a few joins a round: no node's links meet in one task's memory or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyframe.llm.shared import cut, done, joined


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of one orderable type, in any direction; returns (node, root) for every node that has a link, root
    being the component's smallest node. Large-star and small-star rounds alternate until the links form stars; the
    rounds grow with the logarithm of the nodes. A node with a large part of all links, as a star's centre has, meets them by
    broadcast. Links of a node to itself and nulls count for nothing."""
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times")).select("a", F.least("a", "m").alias("m"), "times"), "least")
        # Large star: every larger neighbour goes to the smallest of the neighbourhood.
        large = joined(both, least, "a", 2 * before[0]).filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct(), "large")
        done(edges, least)
        # Small star: every smaller neighbour, and the node itself, goes to the smallest.
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times")), "least")
        small = joined(large, least, "a", large.count()).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        done(large, least)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
