"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """The nodes of edges (a, b), each with the least node it reaches: node, root.

    Alternates two steps until nothing changes: every node hands its least neighbour to its larger neighbours, then to its
    smaller ones. Each step is a grouped minimum, combined before the shuffle, and a join whose hot keys Spark may split; the
    rounds grow with the logarithm of the longest chain. Rounds are cut by checkpoints.
    """
    stars = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = _sum(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        stars = cut(small.select("e.a", "e.b").filter("a != b").distinct())
        if known == (known := _sum(stars)):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sum(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first())
