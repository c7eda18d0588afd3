"""Connected components of a table of links, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b), for each node that has a link.

    Neighbours are never gathered: each round takes minima with partial sums and joins links with them, so
    a node of very many links is split like any large join key. Rounds grow with the logarithm of the size.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = staged(links.where("a <> b").select(a, b).distinct(), "links")
    last = None
    while True:
        links = staged(_small_star(_large_star(links)), "links")
        mark = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        last = mark


def _large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
