"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelith.llm.run import Scratch


def star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """One step: every node's larger (large) or smaller-or-equal (small) neighbours are tied to its least neighbour.

    The least neighbours are written first, so that the join with a hub's many edges is one that Spark can split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")), name)
    if large:
        return both.filter("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    tied = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components", most: int = 200) -> DataFrame:
    """node, component (its least node) of every node that an edge (u, v) names.

    Each step is written to the shared folder; the count and hash of the edges tell when nothing changes.
    Edges that still change after `most` rounds raise an error.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = scratch.write(edges, f"{name}-0")
    before = state(edges)
    for i in range(1, most + 1):
        larger = scratch.write(star(edges, True, scratch, f"{name}-{i}-a"), f"{name}-{i}-b")
        edges = scratch.write(star(larger, False, scratch, f"{name}-{i}-c"), f"{name}-{i}")
        now = state(edges)
        scratch.drop(f"{name}-{i - 1}", f"{name}-{i}-a", f"{name}-{i}-b", f"{name}-{i}-c")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
