"""Links between frames as a 0/1 programme: columns (edge, parent, child1, child2, cost), child2 null for a move; costs are negative where a link is better than none.

A node is the parent of at most one chosen edge and a child of at most one. Edges that share no node, directly or by others,
don't compete, so a choice is made part by part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.operators import graph
from tracelet.operators.assign import assign

CHOSEN = "edge long"


def links(candidates: DataFrame, accept: float, divide: float) -> DataFrame:
    """Columns of all moves and divisions among candidates (a_id, b_id, d2, rank) of two frames: a move costs d2 - accept, a division the sum of both less 2 * accept, plus divide."""
    c = candidates.select(F.col("a_id").alias("parent"), F.col("b_id").alias("child1"), "d2")
    other = c.select("parent", F.col("child1").alias("child2"), F.col("d2").alias("e2"))
    pairs = c.join(other, "parent").filter("child1 < child2")
    rows = c.select("parent", "child1", F.lit(None).cast("long").alias("child2"), (F.col("d2") - accept).alias("cost"))
    rows = rows.unionByName(pairs.select("parent", "child1", "child2", (F.col("d2") + F.col("e2") - 2 * accept + divide).alias("cost")))
    return rows.withColumn("edge", _name("parent", "child1", F.col("child2"))).select("edge", "parent", "child1", "child2", "cost")


def _name(parent: str, child1: str, child2: Column) -> Column:
    return F.xxhash64(parent, child1, F.coalesce(child2, F.lit(-1).cast("long")))


def constraint_rows(columns: DataFrame) -> DataFrame:
    """(edge, row, value): a row for each node as a parent (2 id) and as a child (2 id + 1), all values 1, for assign.constraint_faults."""
    ends = F.array(F.col("parent") * 2, F.col("child1") * 2 + 1, F.col("child2") * 2 + 1)
    return columns.select("edge", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("row"), F.lit(1.0).alias("value"))


def edges_of(nonzeros: DataFrame, costs: DataFrame) -> DataFrame:
    """Columns (edge, parent, child1, child2, cost) back from nonzeros (edge, row, value) and costs (edge, cost)."""
    even = F.col("row") % 2 == 0
    kids = F.array_sort(F.collect_list(F.when(~even, F.floor(F.col("row") / 2))))
    back = nonzeros.groupBy("edge").agg(F.max(F.when(even, F.floor(F.col("row") / 2))).alias("parent"), kids.alias("kids"))
    return back.join(costs, "edge").select("edge", "parent", F.get("kids", F.lit(0)).alias("child1"), F.get("kids", F.lit(1)).alias("child2"), "cost")


def _by_part(columns: DataFrame, choose) -> DataFrame:
    n = constraint_rows(columns)
    parts = graph.components(n.select("row", "edge").join(n.groupBy("edge").agg(F.min("row").alias("first")), "edge").select(F.col("row").alias("u"), F.col("first").alias("v")))
    own = columns.join(parts.withColumnsRenamed({"node": "up"}), F.col("up") == F.col("parent") * 2).drop("up")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cost", "edge"], kind="stable")
        nodes = [frozenset([2 * p, *(2 * int(c) + 1 for c in (a, b) if not pd.isna(c))]) for p, a, b in zip(pdf.parent, pdf.child1, pdf.child2)]
        return pd.DataFrame({"edge": pdf.edge.to_numpy()[choose(pdf.edge.to_numpy(), nodes, pdf.cost.to_numpy(float))]})

    return own.groupBy("component").applyInPandas(run, CHOSEN)


def best_choice(candidates: DataFrame, accept: float, divide: float) -> DataFrame:
    """(edge) of the choice of the least total cost among links(candidates, accept, divide), divide at least 0.

    A child costs d2 - accept wherever it goes, and a parent's second child `divide` more. So children are assigned to first
    and second places of parents, or to none at cost 0, which assign solves exactly in polynomial time.
    """
    place = F.explode(F.array(F.lit(0), F.lit(1)))
    ways = candidates.select(F.col("b_id").alias("src"), "a_id", "d2", place.alias("second"))
    ways = ways.select("src", (F.col("a_id") * 2 + F.col("second")).alias("dst"), (F.col("d2") - accept + divide * F.col("second")).alias("cost"))
    taken = assign(ways, 0.0).filter("dst is not null").select(F.floor(F.col("dst") / 2).alias("parent"), F.col("src").alias("child"))
    pairs = taken.groupBy("parent").agg(F.min("child").alias("child1"), F.max("child").alias("last"))
    second = F.when(F.col("last") != F.col("child1"), F.col("last"))
    return pairs.select(_name("parent", "child1", second).alias("edge"))


def likely_choice(columns: DataFrame, seed: int, warmth: float) -> DataFrame:
    """(edge) of a random choice that breaks no constraint: edges are taken in the order of their costs less warmth times a Gumbel draw, so better ones are likelier first, and kept where they still fit."""

    def choose(edges: np.ndarray, nodes: list[frozenset], cost: np.ndarray) -> list[int]:
        draw = np.array([np.random.default_rng([seed, int(e) & 0xFFFFFFFFFFFFFFFF]).gumbel() for e in edges])
        used, out = set(), []
        for i in np.argsort(cost - warmth * draw, kind="stable").tolist():
            if cost[i] < 0 and not nodes[i] & used:
                used |= nodes[i]
                out.append(i)
        return out

    return _by_part(columns, choose)


def lineages(columns: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (id, ...) with the parent that the chosen edges give them."""
    kept = columns.join(chosen, "edge", "left_semi")
    up = kept.select("parent", F.explode(F.filter(F.array("child1", "child2"), lambda x: x.isNotNull())).alias("id"))
    return nodes.drop("parent").join(up, "id", "left")


def solution_features(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """(feature, total) over the chosen edges; features (edge, feature, value)."""
    return features.join(chosen, "edge", "left_semi").groupBy("feature").agg(F.sum("value").alias("total"))


def spatial_candidates(tree: DataFrame, merges: DataFrame) -> DataFrame:
    """(top, node) of a dendrogram (node, parent, ...): each leaf climbs by merges (node, into, score) as far as they go, and the nodes at and below where it ends are candidates beside each other."""
    from tracelet.operators import trees

    step = tree.select("node").join(merges.groupBy("node").agg(F.max_by("into", "score").alias("to")), "node", "left")
    leaves = trees.children_count(tree.withColumnRenamed("node", "id")).filter("n_children = 0").select("id")
    ends = trees.follow(step.select(F.col("node").alias("id"), "to")).join(leaves, "id").select(F.col("end").alias("id")).distinct()
    marked = tree.withColumnRenamed("node", "id").select("id", "parent").join(ends.withColumn("marked", F.lit(True)), "id", "left")
    return trees.topmost(marked).filter("top is not null").select("top", F.col("id").alias("node"))


def anchored(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Of candidates (top, node) those whose top is among the anchors (node), or holds one."""
    keep = candidates.join(anchors.select("node"), "node", "left_semi").select("top").distinct()
    return candidates.join(keep, "top", "left_semi")


def flow_faults(columns: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, n) of constraint rows that a choice fills more than once."""
    used = constraint_rows(columns.join(chosen, "edge", "left_semi"))
    return used.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1")


def ranked_by_cost(columns: DataFrame) -> DataFrame:
    """columns with each parent's rank of its edges by cost, then edge."""
    return columns.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy("cost", "edge")))
