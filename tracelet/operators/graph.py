"""Undirected graphs as edges (u, v, weight): components, contraction, shortest paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.functions.salts import explode_salts, salt_bits, salt_of
from tracelet.plans.durable import durable


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def roots(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """(node, root) of every node of edges (u long, v long) that has another one: root is the least node that edges reach.

    Alternating stars: neighbours larger than a node, then smaller ones, are tied to the least neighbour; the rows never
    outnumber the edges by more than a constant, and the rounds grow with the logarithm of the longest path. The neighbours
    of a hub are spread over salts by bit maps, so its row is copied at most as often as it has neighbours. A round is the
    last when it changes nothing, as the number of rows and 128 bits of their hashes tell. keep: cuts the lineage.
    """
    now, before = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()), None
    while True:
        around = symmetric(now).withColumn("salt", salt_of("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"), salt_bits("salt").alias("bits")).select("u", F.least("u", "m").alias("m"), explode_salts("bits").alias("salt"))
        large = around.join(least, ["u", "salt"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().withColumn("salt", salt_of("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), salt_bits("salt").alias("bits"))
        small = large.join(low.select("u", "m", explode_salts("bits").alias("salt")), ["u", "salt"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), *[F.bit_xor(F.xxhash64("u", "v", F.lit(k))) for k in (0, 1)]).first()
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the least node that edges reach. nodes (node) adds the isolated ones."""
    every = symmetric(edges).select(F.col("u").alias("node"))
    every = (every if nodes is None else every.union(nodes.select("node"))).distinct()
    return every.join(roots(edges), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), parallel edges once, loops left out."""
    return symmetric(edges).filter("u <> v").distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between groups under mapping (node, into): parallel ones keep the largest weight, loops go."""
    a = mapping.select(F.col("node").alias("u"), F.col("into").alias("gu"))
    b = mapping.select(F.col("node").alias("v"), F.col("into").alias("gv"))
    e = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("gu", "u").alias("u"), F.coalesce("gv", "v").alias("v"), "weight")
    e = e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")
    return e.groupBy("u", "v").agg(F.max("weight").alias("weight"))


def merge_order(edges: DataFrame, peaks: DataFrame) -> DataFrame:
    """(u, v, tau): how far each edge's saddle lies below the lower peak of its ends; peaks (node, peak). The least is what merges first."""
    a = peaks.select(F.col("node").alias("u"), F.col("peak").alias("pu"))
    b = peaks.select(F.col("node").alias("v"), F.col("peak").alias("pv"))
    return edges.join(a, "u").join(b, "v").select("u", "v", (F.least("pu", "pv") - F.col("weight")).alias("tau"))


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, distance, source) from the nearest of sources (node); ties to the smaller source. Weights are at least 0.

    Only nodes whose distance fell in the last round are relaxed from.
    """
    both = edges.select("u", "v", "weight").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    best = durable(sources.select("node", F.lit(0.0).alias("distance"), F.col("node").alias("source")).distinct())
    front = best
    for _ in range(most_rounds):
        step = front.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), "source")
        step = step.groupBy("node").agg(F.min(F.struct("distance", "source")).alias("s")).select("node", F.col("s.distance").alias("d"), F.col("s.source").alias("src"))
        merged = durable(best.join(step, "node", "full").select("node", "distance", "source", "d", "src", (F.col("distance").isNull() | (F.struct("d", "src") < F.struct("distance", "source"))).alias("better")))
        take = F.col("better") & F.col("d").isNotNull()
        best = merged.select("node", F.when(take, F.col("d")).otherwise(F.col("distance")).alias("distance"), F.when(take, F.col("src")).otherwise(F.col("source")).alias("source"))
        front = merged.filter(take).select("node", F.col("d").alias("distance"), F.col("src").alias("source"))
        if front.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Directed rows without their converse, and loops: (u, v, fault)."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select("u", "v").join(back, ["u", "v"], "left_anti").select("u", "v", F.lit("one-sided").alias("fault")).union(edges.filter("u = v").select("u", "v", F.lit("loop").alias("fault")))
