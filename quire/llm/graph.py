"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable over the undirected ``edges``; nodes without an edge are absent.

    Alternates large-star and small-star steps, each one grouped aggregation, until no edge changes; every round is staged.
    A node's neighbours are only reduced to their minimum, never gathered. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = staged(pairs.distinct(), "cc")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour is linked to the least of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "cc")
        # small star: each smaller neighbour, and the node itself, is linked to the least smaller one
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m").union(least.select(F.col("u").alias("x"), "m"))
        small = staged(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        stats = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = stats(small) == stats(now)
        unstage(now, large)
        now = small
        if done:
            break
    star = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = star.select("v").distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("comp")))
