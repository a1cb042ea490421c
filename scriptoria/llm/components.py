"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, unstage


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, part): the smallest node that ``links`` (a, b) of longs reach from each linked node.

    In a large star, every greater neighbour of a node is linked to the node's least
    neighbour; in a small star, every smaller one. The two alternate, each round on a
    table written to the checkpoint folder, until the links stop changing, which takes a number of
    rounds that grows with the logarithm of the size. No node's neighbours are gathered: their
    least one is an aggregate, joined back. The driver sees counts and sums only.
    """
    with scratch(links.sparkSession) as keep:
        edges = stage(
            links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
        )
        before = None
        for _ in range(rounds):
            both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            smallest = large.groupBy("u").agg(F.min("v").alias("m"))
            linked = large.join(smallest, "u")
            small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m").alias("v")))
            last, edges = edges, stage(small.filter("u <> v").distinct(), "links")
            unstage(last)
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"the components did not settle in {rounds} rounds")
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
        roots = stars.select(F.col("part").alias("node"), "part").distinct()
        return keep(stars.unionAll(roots).distinct(), "components")
