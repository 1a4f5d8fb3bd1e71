"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import splittable_join, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or smaller neighbours are tied to the smallest of its neighbours and itself."""
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = splittable_join(ways, least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, root: for each node with an edge, the smallest node of its component. Edges point from the larger to the smaller
    node after each round, and the rounds end when a round changes none; their number grows with the log of the longest
    path. Each round is written to the shared folder; nothing but its count and checksum comes to the driver."""
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = staged(own, "edges"), None
    while True:
        n = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if tuple(n) == before or n[0] == 0:
            break
        before = tuple(n)
        now = staged(_star(_star(now, True), False), "edges")
    roots = now.select("a", F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct())
