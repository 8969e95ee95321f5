"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Adds the least neighbour ``m`` of ``node``. The join's key is another than the
    aggregate's, so both of its sides are shuffled and adaptive execution can split
    the edges of a hub among tasks."""
    least = edges.groupBy(node).agg(F.min(other).alias("m")).select(F.bitwise_not(node).alias("_key"), F.least(node, "m").alias("m"))
    return edges.withColumn("_key", F.bitwise_not(node)).join(least, "_key").drop("_key")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is
    the smallest node reachable.

    Each step replaces a node's edges by edges to its least neighbour, so the
    number of edges never grows and the depth of the trees falls by a power each
    round. All steps are group-by minima (combined before the shuffle) and joins
    that adaptive execution can split; every round is kept as a table until the
    next is written, and the driver sees a count and a checksum only. Edges with a
    null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"), F.col(u).alias("_u"), F.col(v).alias("_v"))
    e = stored(e.where("_u IS NOT NULL AND _v IS NOT NULL AND hi <> lo").select("hi", "lo").distinct(), "edges")
    before = _state(e)
    while before[0]:
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        large = stored(_with_least(sym, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        small = _with_least(large, "hi", "lo").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x"))
        found = stored(small.select("x.hi", "x.lo").where("hi <> lo").distinct(), "edges")
        forget(e, large)
        e = found
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
