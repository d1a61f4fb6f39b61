"""One-to-one assignment over candidate pairs (group, src, dst, cost)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelet.operators import graph


def assign_edges(src: np.ndarray, dst: np.ndarray, cost: np.ndarray, refusal: float) -> dict:
    """dst of each src, None where leaving it out (at cost refusal) is better. Every src may be left out on its own.

    A src at a time takes the cheapest way through the edges of those already placed: a shortest path over dual prices,
    which ends at a free dst, or where one on the way is left out instead. Only edges are held, none that isn't given.
    """
    rows, columns = np.unique(src), np.unique(dst)
    n, m = len(rows), len(columns)
    order = np.lexsort([cost, np.searchsorted(columns, dst), np.searchsorted(rows, src)])
    r, c, w = np.searchsorted(rows, src)[order], np.searchsorted(columns, dst)[order], cost[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])  # of parallel edges the cheapest
    r, c, w = r[first], c[first], w[first].astype(float)
    starts = np.searchsorted(r, np.arange(n + 1))
    column_price = np.zeros(m)
    owner, place = np.full(m, -1), np.full(n, -1)
    paid = np.zeros(n)  # cost of the edge that a row holds
    for start in range(n):
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        out, out_row, row, base = refusal, start, start, 0.0
        while True:
            for e in range(starts[row], starts[row + 1]):
                j = int(c[e])
                d = base + w[e] - column_price[j]
                if j not in done and d < best.get(j, np.inf):
                    best[j], came[j] = d, row
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in done or heap[0][0] > best[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] > out:
                end, column = out, -1
                break
            d, j = heapq.heappop(heap)
            done.add(j)
            if owner[j] < 0:
                end, column = d, j
                break
            row = int(owner[j])
            base = d - (paid[row] - column_price[j])
            if base + refusal < out:
                out, out_row = base + refusal, row
        for j in done:
            if best[j] < end:
                column_price[j] -= end - best[j]
        if column < 0:  # out_row is left out, those before it move up
            column = place[out_row]
            place[out_row] = -1
            if out_row == start:
                continue
        while True:
            row = came[column]
            free, place[row], owner[column] = place[row], column, row
            paid[row] = w[starts[row] + np.searchsorted(c[starts[row] : starts[row + 1]], column)]
            if row == start:
                break
            column = free
    return {rows[i].item(): columns[j].item() if j >= 0 else None for i, j in enumerate(place)}


def assign(candidates: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, cost) of the least total over candidates (src, dst, cost) with cost < threshold; dst is null where a source stays out at the cost of the threshold.

    Sources and destinations that no chain of candidates connects can't compete, so each connected part is solved by
    itself, in one task.
    """
    edges = candidates.filter(F.col("cost") < threshold).select("src", "dst", "cost")
    # destinations get odd numbers, sources even ones
    parts = graph.components(edges.select((F.col("src") * 2).alias("u"), (F.col("dst") * 2 + 1).alias("v")))
    own = parts.select((F.col("node") / 2).cast("long").alias("src"), "component", (F.pmod("node", F.lit(2)) == 0).alias("even")).filter("even").drop("even")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = assign_edges(pdf.src.to_numpy(), pdf.dst.to_numpy(), pdf.cost.to_numpy(), threshold)
        cost = pdf.groupby(["src", "dst"]).cost.min()
        rows = [(s, d, threshold if d is None else cost[s, d]) for s, d in got.items()]
        return pd.DataFrame({"src": [r[0] for r in rows], "dst": pd.array([r[1] for r in rows], "Int64"), "cost": [float(r[2]) for r in rows]})

    solved = edges.join(own, "src").groupBy("component").applyInPandas(solve, "src long, dst long, cost double")
    left = candidates.select("src").distinct().join(edges.select("src").distinct(), "src", "left_anti")
    return solved.unionByName(left.select(F.col("src").cast("long"), F.lit(None).cast("long").alias("dst"), F.lit(float(threshold)).alias("cost")))


def extend_one_to_one(matching: DataFrame, candidates: DataFrame, cap: float | None = None) -> DataFrame:
    """Pairs (src, dst, cost) that both ends, unmatched so far, rank first, up to the cap: what a matching can clearly be extended with."""
    free = candidates.join(matching.filter("dst is not null").select("src"), "src", "left_anti").join(matching.filter("dst is not null").select("dst"), "dst", "left_anti")
    if cap is not None:
        free = free.filter(F.col("cost") <= cap)
    by_src = Window.partitionBy("src").orderBy("cost", "dst")
    by_dst = Window.partitionBy("dst").orderBy("cost", "src")
    return free.withColumn("a", F.row_number().over(by_src)).withColumn("b", F.row_number().over(by_dst)).filter("a = 1 and b = 1").select("src", "dst", "cost")


def prune_hypotheses(edges: DataFrame, most_moves: int = 5, most_divisions: int = 3, share: float = 0.25) -> DataFrame:
    """(parent, child1, child2, cost, rank) of each parent's hypotheses in cost order (costs are negative): while cost / best is at least the share, at most so many displacements (child2 null) and divisions."""
    kind = F.col("child2").isNull()
    order = Window.partitionBy("parent").orderBy("cost", "child1", "child2")
    within = Window.partitionBy("parent", kind).orderBy("cost", "child1", "child2")
    e = edges.withColumn("best", F.min("cost").over(Window.partitionBy("parent"))).withColumn("turn", F.row_number().over(within))
    e = e.filter(F.col("cost") / F.col("best") >= share).filter(F.col("turn") <= F.when(kind, most_moves).otherwise(most_divisions))
    return e.withColumn("rank", F.row_number().over(order)).select("parent", "child1", "child2", "cost", "rank")


def constraint_faults(columns: DataFrame, nonzeros: DataFrame, chosen: DataFrame) -> DataFrame:
    """Total cost and number of rows over 1 of a choice: columns (edge, cost), nonzeros (edge, row, value), chosen (edge)."""
    total = columns.join(chosen, "edge").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    rows = nonzeros.join(chosen, "edge").groupBy("row").agg(F.sum("value").alias("s")).filter("s > 1").agg(F.count("*").alias("n_broken"))
    return total.crossJoin(rows)
