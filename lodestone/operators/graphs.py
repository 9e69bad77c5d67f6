"""Connected components by alternating stars, as joins and minima over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import dropped, scratch, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the smallest node that it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest of them, which halves long paths; it ends when a round changes
    nothing. The table never has more rows than edges. Loops (a = a) give their
    node a root; edges with a null end are left out.
    """
    spark = edges.sparkSession
    known = edges.where("a is not null and b is not null")
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    at = scratch(spark, "stars")
    held = written(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), at)
    mark = (-1, None)
    while True:
        # Larger neighbours hang on the smallest of a node's neighbours and itself.
        both = held.union(held.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # A node and its smaller neighbours hang on the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after_at = scratch(spark, "stars")
        after = written(small.union(small_least.select("a", "m")).distinct(), after_at)
        now = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        dropped(spark, at)
        held, at = after, after_at
        if now == mark:
            break
        mark = now
    return nodes.join(held.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
