"""Connected components over an edge table, by alternating large-star and small-star steps (Kiveris et al.
2014): every step is one aggregation and one join, and no vertex's neighbours ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import spread_join, unwritten, written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``: the smallest node that links reach.

    Nodes without edges are absent. Loops, repeated edges and nulls are ignored; no edge gives no row.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc")
    state = _digest(e)
    while True:
        total = state[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        # large star: every larger neighbour of a vertex moves to the vertex's smallest neighbour
        large = spread_join(both, low, "u", "degree", 2 * total, F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "cc")
        # small star: every smaller neighbour, and the vertex itself, moves to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = spread_join(large, low, "u", "degree", total, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        before, e = e, written(small.where("u <> v").distinct(), "cc")
        unwritten(before, large)
        now = _digest(e)
        if now == state:
            break
        state = now
    out = e.groupBy("u").agg(F.min("v").alias("component"))
    return out.select(F.col("u").alias("node"), "component").unionByName(
        out.select(F.col("component").alias("node"), "component").distinct())


def least_reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node, first)`` to ``(node, least)``: the smallest ``first`` among the nodes that links reach, nulls
    aside, its own if it has no link."""
    group = written(components(edges).join(nodes, "node"), "group")
    least = group.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("size"))
    linked = spread_join(group.select("node", "component"), least, "component", "size", group.count(), F.col("node")).select("node", "least")
    return nodes.join(linked.withColumn("linked", F.lit(True)), "node", "left").select("node", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("least"))


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(v as decimal(20,0))"))).first()
    return tuple(r)
