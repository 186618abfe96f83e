"""Connected components of a link table, as alternating large-star and small-star steps.

Each step is union-find's hooking and path halving for all nodes at once; the links never leave
the executors, and the driver sees only two sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): connect the neighbours of each node to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (u, v) long -> one row (node, component) per linked node; component: its least node.

    Self-links and repeated links are harmless; null ends are dropped; no links give no rows.
    """
    edges = scratch.put(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:  # each round shortens what is longer than a star
        nxt = scratch.put(_star(_star(edges, True), False))
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = nxt
        if state == before or not state[0]:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
