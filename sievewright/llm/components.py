"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

MAX_ROUNDS = 60


def _to_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Link neighbours to the least node around `u`: the larger ones (upward) or the smaller ones and `u`."""
    if upward:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if upward:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its least node.

    Each round writes the contracted edges to the shared folder and deletes those of the round before. A node
    with very many links is one row per task when its least neighbour is sought; the join back can be split.
    Self-links are ignored. No edges give no rows.
    """
    u, v = F.least("u", "v"), F.greatest("u", "v")
    now = settle(edges.where("u <> v").select(v.alias("u"), u.alias("v")).distinct(), "cc")
    mark = None
    for _ in range(MAX_ROUNDS):
        after = settle(_to_least(_to_least(now, True), False), "cc")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        discard(now)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return linked.unionByName(roots)
