"""Union-find grouping of links as Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import stored


def groups(links: DataFrame) -> DataFrame:
    """(node, root) for every end of the links (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows that once, and
    replaces the ends of the links by what they were hooked to. Links inside a
    group vanish and the others are made distinct, so a group with many members
    soon is one node with few links. Rounds grow with the logarithm of a group's width.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    roots = stored(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root")), "roots")
    while not links.isEmpty():
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = stored(ends.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "hooks")
        above = smallest.select(F.col("root").alias("up"), F.col("up").alias("top"))
        hooked = stored(smallest.join(above, "up").select("root", F.least("up", "top").alias("up")), "hooks")
        for end in ("a", "b"):
            links = links.join(hooked.withColumnRenamed("root", end), end).drop(end).withColumnRenamed("up", end)
        links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        roots = stored(roots.join(hooked, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
    return roots
