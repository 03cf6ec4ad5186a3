"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = written(both.groupBy("u").agg(F.min("v").alias("m")), "star")  # the join can split a hot node
    return (
        both.where("v > u")
        .join(least.hint("merge"), "u")
        .select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, on the smallest of them."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
    moved = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; the root is the smallest node reachable.

    ``edges`` has bigint columns ``a`` and ``b``, in any direction. A round works on group
    minima and one join per star, so a node with very many edges is never gathered; every round
    is a written table, so plans stay the same size, and rounds end when nothing changes.
    """
    edges = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
