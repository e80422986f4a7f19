"""Connected components by alternating large-star and small-star contraction (published map-reduce method).

Every step is a partial aggregate (minimum of a node's neighbours) and an equi join, so a node with very many
neighbours is pre-aggregated and its join side can be split at run time. Each round ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge ``(a, b)``; root is the component's smallest node.

    Self loops and repeated edges are allowed, null ends are ignored. No edge gives an empty result.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = cut(pairs), None
    while True:
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = state.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
