"""Connected components of an edge table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import shared


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links`: u, v. Returns node, component (the smallest reachable node) for nodes that are not the smallest of theirs.

    No neighbourhood is ever gathered: a node's smallest neighbour is an aggregate, and a hub's
    edges stay rows of a join. Every round is written to the shared folder; it ends when a round
    leaves the edges as they were. Null ends and loops are no links; no links give no rows.
    """
    edges = shared(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        edges = shared(_smaller(_larger(edges)))
