"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction: every node's neighbours move to the least one among them and the node.

    The large star moves neighbours above the node, the small star those below it.
    Both keep the components. A node with very many neighbours only meets a minimum
    with map-side combining and a join that Spark can split.
    """
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger:
        pairs = pairs.where("v < u")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = pairs.where("v > u") if larger else pairs
    joined = moved.join(least, "u")
    found = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        found = found.unionByName(least.select("u", F.col("m").alias("v")))
    return found.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node ``u`` of the edges (u, v) that is not itself the least of its component.

    ``root`` is that least node. Direction and repeats of edges do not matter.
    Each round is written, so lineage stays short; rounds grow with the logarithm
    of the longest chain. Two numbers per round reach the driver.
    """
    mark = None
    current = materialize(edges.select("u", "v").where("u != v"), "edges")
    while True:
        current = materialize(_stars(_stars(current, True), False), "stars")
        now = current.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return current.withColumnRenamed("v", "root")
        mark = now
