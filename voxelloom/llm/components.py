"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins with a per-node minimum (partial aggregation first, so a node with very many
neighbours is never gathered), written to the shared folder. Chains of length n need about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.session import discard, written

MAX_ROUNDS = 60


def _star(e: DataFrame, large: bool) -> DataFrame:
    if large:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = e.join(least, F.col("u") == F.col("k")).select("v", "m")
    linked = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: label is the smallest node of the node's component. ``edges``: u, v, any order."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "cc-edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        before, e = e, written(_star(_star(e, large=True), large=False), "cc-round")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
