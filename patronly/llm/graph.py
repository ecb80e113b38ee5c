"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _to_smallest(links: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours linked to the smallest of them (and of itself).

    With ``both_ways`` that is done for larger neighbours (large star), else for smaller
    ones (small star). Neither step changes what is connected.
    """
    ways = links.select("a", "b")
    if both_ways:
        ways = ways.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = ways.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = ways.join(least, F.col("a") == F.col("n"))
    if both_ways:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest connected node.

    Large-star and small-star steps alternate until nothing changes; each round's links
    are stored, so no plan grows and a lost executor costs one round. The number of links
    never grows, and a node with very many neighbours only meets them in sums and in a
    join that Spark can split.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
        links = materialize(_to_smallest(_to_smallest(links, True), False))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
