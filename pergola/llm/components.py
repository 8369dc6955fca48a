"""Connected components of links as tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergola.llm._arrow import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are tied to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component, with a row of its own) for all nodes of a table of links a, b of any orderable type.

    Each round is two aggregations and two joins, written to the shared folder; rounds end when a round changes nothing. Links from a node
    to itself and repeated links are allowed; an empty table gives no rows.
    """
    edges = written(edges)
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen.n == 0 or (seen.n, seen.x) == mark:
            break
        mark = (seen.n, seen.x)
        now = written(_small_star(_large_star(now)))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = stars.select(F.col("root").alias("node")).unionByName(loops).distinct().join(stars, "node", "left_anti").select("node", F.col("node").alias("root"))
    return stars.unionByName(own)
