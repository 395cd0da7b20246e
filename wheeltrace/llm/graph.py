"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.operators.scale import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or smaller) neighbours of each node to the least of its neighbours."""
    if large:
        sides = edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                    F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
                )
            ).alias("side")
        ).select("side.u", "side.v")
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    linked = sides.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("b"), F.col("least").alias("a"))
    else:
        own = least.where("least < u").select(F.col("u").alias("b"), F.col("least").alias("a"))
        linked = linked.select(F.col("v").alias("b"), F.col("least").alias("a")).union(own)
    return linked.where("a < b").select("a", "b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node of `edges` (a, b); component_id is the least node.

    Each round writes its edges to the shared folder and costs a few shuffles of two longs
    per edge; the number of rounds grows with the logarithm of the longest path. A hub's
    edges are read by several tasks, as Spark splits skewed join partitions.
    """
    edges = materialize(
        edges.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("mark")
        ).first()
        if mark == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component_id")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component_id")).distinct()
            )
        seen = mark
        edges = materialize(_stars(_stars(edges, large=True), large=False), "edges")
