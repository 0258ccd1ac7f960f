"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from worklens.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node it is connected with.

    Alternating large and small stars: every node hands its larger, then its smaller
    neighbours to its smallest one, until only stars are left, in a number of rounds
    that is logarithmic in practice. Minima are aggregated before the shuffle and
    joined back, so a node with very many neighbours is split like any skewed join.
    Loops and repeated edges change nothing; the smallest node is its own root.
    """
    stars = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        stars = written(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
