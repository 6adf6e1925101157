"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.session import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``m``, the least of u and all its v. The minimum combines before the shuffle, however many v a u has."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    near = _with_least(pairs)
    moved = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for each node that has an edge to a smaller one; roots have no row.

    ``edges`` has two columns of longs, in either order. Every round is written to the shared folder, so a lost executor
    costs no earlier round. The rounds end when a round changes nothing; they grow with the logarithm of the diameter.
    """
    a, b = edges.columns
    oriented = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    pairs, before = materialize(oriented, "edges"), None
    while True:
        pairs = materialize(_small_star(_large_star(pairs)), "stars")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
