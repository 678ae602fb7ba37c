"""Connected components of a table of links, by rounds of star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest neighbour, then its
    smaller ones. The number of rounds grows with the logarithm of the longest path, and links never multiply. A node's links
    are grouped by partial minima, so a node that a third of all nodes link to needs no task of its own.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, before = materialize(links, "links"), None
    while True:
        links = materialize(small_star(large_star(links)), "links")
        seen = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if seen == before:
            break
        before = seen
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.join(links.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    )


def large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; ``a`` is the larger end of every link."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()
