"""Connected components of links, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reverie.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to node, component (the least node reachable), a row for each node of a link.

    Alternating large and small stars: each node's least neighbour is an aggregate, which then
    joins back to its edges, so that no node's edges meet in one group. Each round is written to
    the shared folder; the rounds end when the edges no longer change.
    """
    edges = written(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "stars", 16)
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("m").alias("v"), F.explode(F.array("u", "v")).alias("u")).where("u <> v").distinct()
        edges = written(small, "stars", 16)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
