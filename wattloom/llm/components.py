"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import staged


def _minima(pairs: DataFrame, name: str) -> DataFrame:
    """Smallest neighbour of each node, or itself. Written, so that a join with it can split a hub's rows."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)


def _star(pairs: DataFrame, name: str) -> DataFrame:
    """Links every neighbour, and the node itself, to the smallest of them."""
    return pairs.join(_minima(pairs, name), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node reachable.

    Both kinds of rounds keep components and shorten paths, so the number of rounds grows
    with the logarithm of the longest path. Each round's links are written to the shared
    folder; the driver only reads their count and a checksum to see that nothing changed.
    Links with a null end and self-links are ignored; repeated links count once.
    """
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = staged(large, "large_star")
        small = _star(large, "small")  # u > v in all rows
        now = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small_star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Every node now hangs on its root directly.
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
