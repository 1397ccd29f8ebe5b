"""Connected components of an edge table, as joins and sums in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.session import stage, unstage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of ``edges`` (``a``, ``b``).

    Large-star and small-star rounds: each links the neighbours of a node to the smallest of them,
    until all edges are stars. Every round is a sum by node and a join, so a node with very many
    neighbours is one row of the sum, and adaptive execution splits its part of the join. Loops,
    repeated edges and nulls are harmless (edges with a null are left out).
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    state = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(state)
    while True:
        # large star: larger neighbours of a node go to the smallest of the node and its neighbours
        ways = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "links-large")
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct(), "links")
        mark = _mark(after)
        unstage(large)
        unstage(state)
        state = after
        if mark == before:
            break
        before = mark
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
