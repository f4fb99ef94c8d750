"""Connected components of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.settle import settle


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the smallest node of the connected component.

    Large-star and small-star rounds, whose number grows with the logarithm of the longest
    path and not with the path. They end when a round leaves the number of edges and 128
    bits of hashes over them as they were.
    """
    edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark_of = lambda e: e.agg(F.count("*"), *[F.bit_xor(F.xxhash64("a", "b", F.lit(k))) for k in (0, 1)]).first()
    mark = mark_of(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges, before = settle(small), mark
        mark = mark_of(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
