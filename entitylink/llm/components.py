"""Connected components by alternating large-star and small-star steps.

Both steps are joins of the edges with one minimum per node, so no task holds a node's neighbours; the
edges of hot nodes are dealt over many tasks.  Every round is written to the shared folder and the one
before dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, meet


#: With fewer edges, one task may well hold all of a node's.
HOT = 100_000


def components(edges: DataFrame, scratch: Scratch, name: str = "components", most: int = 60) -> DataFrame:
    """(u, v) of any orderable type -> (node, component): each node that has an edge, with its component's smallest node.

    Loops, repeated edges and nulls (no edge) are allowed; no edges give no rows.
    """
    e = edges.select("u", "v").where(F.col("u") != F.col("v"))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = scratch.save_seen(e, f"{name}-0", *_state())
    for i in range(1, most + 1):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both.where(F.col("v") > F.col("u")), low, ["u"], _hot(both, seen), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        if seen[0] > HOT:
            large = scratch.save(large, f"{name}-large-{i}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = meet(large, low, ["u"], _hot(large, seen), ["v"])
        small = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e, now = scratch.save_seen(small.distinct(), f"{name}-{i}", *_state())
        scratch.drop(f"{name}-{i - 1}", f"{name}-large-{i}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _hot(e: DataFrame, seen: tuple) -> list:
    return hot_keys(e.groupBy("u").agg(F.count(F.lit(1)).alias("n")), ["u"]) if seen[0] > HOT else []


def _state() -> tuple:
    """Count and order-free hash of the edges: equal when a round changed nothing."""
    h = F.xxhash64("u", "v")
    return F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
