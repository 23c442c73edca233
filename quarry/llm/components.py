"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of the links a - b. Each step is one aggregation;
    the links stay distributed, and a written table a round cuts the lineage. A round attaches each node's larger (then
    smaller) neighbours to its least one, until nothing moves; stars stay at one link a node."""
    edges = written(_tidy(links.select("a", "b")), "links")
    while True:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = written(_star(large, larger=False), "links")
        state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state(small) == state(edges):
            break
        edges = small
    return small.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _tidy(e: DataFrame) -> DataFrame:
    """Larger end in a, smaller in b."""
    return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(e: DataFrame, larger: bool) -> DataFrame:
    """Large star: every node above its own is attached to the least of the neighbourhood; e has both directions. Small
    star: every smaller neighbour and the node itself are; e has the larger end in a."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = e.join(least, "a")
    if larger:
        return _tidy(met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    own = least.select("a", F.col("m").alias("b"))
    return _tidy(met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own))
