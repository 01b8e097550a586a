"""Connected components of a table of links, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from variscope.session import cut


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; the component is the smallest id reachable.

    Alternates two steps until nothing changes: each node hands its larger neighbours its smallest
    one, then its smaller neighbours and itself theirs. Links turn into stars around the
    smallest id in a number of rounds that grows with the logarithm of the longest path. Minima are
    pre-aggregated, and every round is written to the shared folder, so a lost executor repeats
    tasks of one round. Links with a null end, and from an id to itself, count for nothing.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    selves = pairs.where("u = v").select(F.col("u").alias("id"))
    edges = cut(pairs.where("u <> v").distinct())
    before = None
    while (now := _sum(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
    star = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).unionByName(selves.select("id", F.col("id").alias("component")))
    return star.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
