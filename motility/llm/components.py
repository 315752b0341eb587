"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

A step needs a shuffle or three whatever the components look like; the edges are written to the shared
folder after each pair of steps, so nothing is recomputed when an executor is lost. Those of the pair before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motility.llm.common import Scratch, grows


def _written(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and a sum of their hashes, read from its files."""
    table = scratch.write(edges, "edges")
    return table, tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbours and itself. As many edges as before, some perhaps twice."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(grows(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(grows(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def linked(edges: DataFrame, max_steps: int = 64) -> tuple[DataFrame, int]:
    """``connected_components`` of the edges, and how many rows it has."""
    scratch = Scratch(edges.sparkSession, "components")
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = _written(scratch, edges)
    for _ in range(max_steps):
        if not before[0]:
            break
        old = edges
        edges, now = _written(scratch, small_star(large_star(old)))
        scratch.drop(old)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")), before[0]


def connected_components(edges: DataFrame, max_steps: int = 64) -> DataFrame:
    """Maps each node of ``edges(u, v)`` that isn't the least of its component to it: ``(node, component)``.

    Self loops, repeated edges and edges in both directions do no harm; nulls are left out. No edges: no rows.
    Raises if the steps do not converge (each pair of steps at least halves long chains, so 64 are ample).
    """
    return linked(edges, max_steps)[0]
