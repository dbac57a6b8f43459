"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a map-side combined minimum by node and a join back, so a node of very high degree is never gathered in
one task. Each round is a stored table; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, stored


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """edges (a, b), a > b. Large: link the larger neighbours of each node to its least one. Small: the smaller ones and itself."""
    side = F.broadcast if few else (lambda df: df)
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        out = both.join(side(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        out = edges.join(side(least), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", "least"))
    return out.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) in any direction, repeats and self-loops allowed. Returns (id, component) for every node
    that is not the least of its component; component is the least node reachable. Null ends are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
        open_, n = nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))), F.sum("up")).first()
        if not open_:  # every node hangs on one other, and that one on none
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        few = 2 * 64 * n <= BROADCAST_BYTES
        now = stored(_star(_star(now, True, few), False, few).distinct(), "edges")
