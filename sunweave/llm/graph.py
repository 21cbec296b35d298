"""Connected components of a link table by alternating stars, one shuffle-bounded round at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.session import stage


def _stars_only(edges: DataFrame) -> bool:
    """Every node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or (up = 1 and down = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node reachable.

    Large-star then small-star rounds. Each takes the smallest neighbour by a partially aggregated
    ``groupBy`` and joins it back, so a hub with millions of links is never one row or one group in
    memory. Rounds grow with the logarithm of the component size; each is written to the shared
    folder, so a lost executor costs one round. Self links and repeated links are allowed; null ends
    are ignored; no links give no rows. Result columns are always ``node`` and ``root``.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = edges.where("a is not null and b is not null").distinct()
    loops = edges.where(F.col("a") == F.col("b"))
    edges = stage(edges.where(F.col("a") != F.col("b")), "links")
    loops_nodes = loops.select(F.col("a").alias("node"))
    while not _stars_only(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large["a"] == low["u"])
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(own).where("a != b").distinct(), "links")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    alone = loops_nodes.join(found.select("node").unionByName(roots.select("node")), "node", "left_anti")
    return found.unionByName(roots).unionByName(alone.withColumn("root", F.col("node")))
