"""Connected components by alternating large and small stars (both narrow joins and combined minima).

Each round is staged, so a lost executor costs one round; the number of rounds grows with the logarithm of the longest
chain.  A node with very many links meets only a combined minimum and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Neighbours of ``u`` as ``v``; those ``keep`` asks for, and ``u``, are linked to the least of ``u`` and all of them."""
    # staged, so both sides of the join arrive by an exchange of their own and a hot node can be split
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    linked = pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    ``edges`` has columns ``a, b`` in any direction, repeats and loops allowed; without edges there are no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = stage(links, "links")
    before = None
    while (now := _mark(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _star(_star(both, "v > u"), "true")  # every link leads from the larger node to the smaller
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
