"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b of one type, never null).

    Large-star and small-star steps in turn until every node that isn't its component's least is linked with that alone:
    every step moves each link to a smaller node, hot nodes are met by partial aggregation and skew-split joins, and the
    number of rounds is logarithmic. Each round is written to the shared folder. Loops and repeated links do no harm.
    """
    both = links.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = settle(both, "links")
    while True:
        # large star: every larger neighbour of a node is linked with the node's least neighbour
        sym = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links-large", edges)
        # small star: a node and its smaller neighbours are linked with the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = settle(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links-small", large)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        several = (F.col("ups") > 1) | ((F.col("ups") > 0) & F.col("root"))
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.bool_or(F.col("up") == 0).alias("root")).filter(several).limit(1).count() == 0:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
