"""Connected components by alternating star contraction: joins and aggregates only, a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.store import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame, least: DataFrame) -> DataFrame:
    """Every neighbour of a node linked to the least node that the node or one of its neighbours is."""
    linked = neighbours.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the links ``a, b`` of numbers; ``root`` is the least node reachable.

    Large stars link a node's larger neighbours to its least neighbour, small stars its smaller ones; each keeps the
    components, and the rounds end when both leave the links as they are. Minima are combined before they are
    shuffled; a node with very many links is a hot join key, which Spark splits. No links give no rows.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = _both_ways(links)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(_star(both.where("b > a"), least).distinct(), "large-stars")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-stars")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
