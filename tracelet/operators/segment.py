"""Watershed with persistence, merge trees of regions, and cuts of them.

Flooding a frame is sequential by nature, so a frame is one task: voxels
(frame, voxel_id, x, y, z, v) in, labels or a tree out. What follows (cuts,
sizes, suggestions) is relational, in operators.trees.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.operators.regions import neighbour_offsets

NEVER = 65535  # the merge height of regions that don't touch


class Forest:
    """Components with their peaks; a union keeps the higher peak."""

    def __init__(self):
        self.up: list[int] = []
        self.peak: list[float] = []

    def new(self, peak: float) -> int:
        self.up.append(len(self.up))
        self.peak.append(peak)
        return len(self.up) - 1

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> int:
        """b goes into a."""
        self.up[b] = a
        self.peak[a] = max(self.peak[a], self.peak[b])
        return a


def flood(place: dict[tuple, int], at: list[tuple], v: np.ndarray, ids: np.ndarray, tau: float, offsets) -> tuple[np.ndarray, Forest, dict[tuple[int, int], float]]:
    """Component of each voxel, the components, and the highest saddle of components left apart.

    Voxels come in order of (v descending, id). A voxel joins the component of its highest labelled neighbour; of the
    components around it, those that rise at most tau above it are united with the one of the highest peak.
    """
    forest, label = Forest(), np.full(len(v), -1)
    saddles: dict[tuple[int, int], float] = {}
    for i in np.lexsort([ids, -v]).tolist():
        x, y, z = at[i]
        best, around = -1, []
        for dx, dy, dz in offsets:
            j = place.get((x + dx, y + dy, z + dz))
            if j is not None and label[j] >= 0:
                around.append(int(label[j]))
                if best < 0 or v[j] > v[best]:
                    best = j
        if best < 0:
            label[i] = forest.new(float(v[i]))
            continue
        label[i] = label[best]
        comps = sorted({forest.root(c) for c in around}, key=lambda c: (-forest.peak[c], c))
        top = comps[0]
        for c in comps[1:]:
            if forest.peak[c] - v[i] <= tau:
                forest.join(top, c)
        left = sorted({forest.root(c) for c in comps})
        for a in range(len(left)):
            for b in left[a + 1 :]:
                saddles[left[a], b] = max(saddles.get((left[a], b), -np.inf), float(v[i]))
    merged: dict[tuple[int, int], float] = {}
    for (a, b), h in saddles.items():
        a, b = sorted((forest.root(a), forest.root(b)))
        if a != b:
            merged[a, b] = max(merged.get((a, b), -np.inf), h)
    return label, forest, merged


def _flooded(pdf: pd.DataFrame, threshold: float, tau: float, connectivity: int):
    pdf = pdf[pdf.v > threshold].sort_values("voxel_id", kind="stable")
    at = list(zip(pdf.x.tolist(), pdf.y.tolist(), pdf.z.tolist()))
    label, forest, saddles = flood({p: i for i, p in enumerate(at)}, at, pdf.v.to_numpy(float), pdf.voxel_id.to_numpy(), tau, neighbour_offsets(connectivity))
    root = np.array([forest.root(c) for c in label], int)
    peak = np.array([forest.peak[r] for r in root])
    number: dict[int, int] = {}
    out = np.zeros(len(root), int)
    for i in np.flatnonzero(peak > tau):
        out[i] = number.setdefault(int(root[i]), len(number) + 1)
    return pdf, out, forest, number, saddles


def watershed(voxels: DataFrame, threshold: float, tau: float, connectivity: int) -> DataFrame:
    """(frame, voxel_id, label): foreground voxels (v > threshold); components whose peak is at most tau get label 0, others are numbered from 1 by first appearance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, label, *_ = _flooded(pdf, threshold, tau, connectivity)
        return pd.DataFrame({"frame": kept.frame, "voxel_id": kept.voxel_id, "label": label.astype("int32")})

    return voxels.select("frame", "voxel_id", "x", "y", "z", F.col("v").cast("double")).groupBy("frame").applyInPandas(run, f"frame {dict(voxels.dtypes)['frame']}, voxel_id long, label int")


def merge_tree(peaks: dict[int, float], saddles: dict[tuple[int, int], float]) -> list[tuple[int, int | None, float, int | None]]:
    """Nodes (node, parent, height, region) of merging, again and again, the pair whose saddle lies least below its lower peak. Nodes that never touch are joined at NEVER. Node 0 is the root; children follow parents breadth first."""
    height = {r: 0.0 for r in peaks}
    region: dict[int, int | None] = {r: r for r in peaks}
    kids: dict[int, tuple[int, int]] = {}
    peak = dict(peaks)
    edges: dict[int, dict[int, float]] = {r: {} for r in peaks}
    for (a, b), h in saddles.items():
        edges[a][b] = edges[b][a] = h
    heap = [(min(peak[a], peak[b]) - h, a, b) for (a, b), h in saddles.items()]
    heapq.heapify(heap)
    fresh = max(peaks, default=0) + 1
    while heap:
        tau, a, b = heapq.heappop(heap)
        if a not in edges or b not in edges or b not in edges[a] or min(peak[a], peak[b]) - edges[a][b] != tau:
            continue
        n, fresh = fresh, fresh + 1
        height[n] = max(tau, height[a], height[b])
        region[n], kids[n], peak[n] = None, (a, b), max(peak[a], peak[b])
        edges[n] = {}
        for old in (a, b):
            for c, h in edges.pop(old).items():
                if c in (a, b):
                    continue
                edges[c].pop(old)
                h = max(h, edges[n].get(c, -np.inf))
                edges[n][c] = edges[c][n] = h
        for c, h in edges[n].items():
            heapq.heappush(heap, (min(peak[n], peak[c]) - h, min(n, c), max(n, c)))
    tops = sorted(edges)
    while len(tops) > 1:
        n, fresh = fresh, fresh + 1
        height[n], region[n], kids[n] = NEVER, None, (tops[0], tops[1])
        tops = [n, *tops[2:]]
    out, todo = [], [(tops[0], None)] if tops else []
    for name, (old, parent) in enumerate(todo):
        out.append((name, parent, float(height[old]), region[old]))
        todo.extend((k, name) for k in kids.get(old, ()))
    return out


def dendrogram(voxels: DataFrame, threshold: float, min_tau: float, connectivity: int) -> DataFrame:
    """(frame, node, parent, thr, region) of each frame's merge tree over its watershed at min_tau; a leaf's region is its label."""
    schema = f"frame {dict(voxels.dtypes)['frame']}, node int, parent int, thr double, region int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, forest, number, saddles = _flooded(pdf, threshold, min_tau, connectivity)
        peaks = {n: forest.peak[r] for r, n in number.items()}
        between = {tuple(sorted((number[a], number[b]))): h for (a, b), h in saddles.items() if a in number and b in number}
        rows = merge_tree(peaks, between)
        return pd.DataFrame(
            {"frame": pdf.frame.iloc[:1].repeat(len(rows)).to_numpy(), "node": [r[0] for r in rows], "parent": pd.array([r[1] for r in rows], "Int32"), "thr": [r[2] for r in rows], "region": pd.array([r[3] for r in rows], "Int32")}
        )

    return voxels.select("frame", "voxel_id", "x", "y", "z", F.col("v").cast("double")).groupBy("frame").applyInPandas(run, schema)


def suggest_merge(node_voxels: DataFrame, tree: DataFrame, max_tau: float, duplicate: float = 0.1) -> DataFrame:
    """(node, into, score): the parent that a node may merge into. node_voxels (node, voxel_id), tree (node, parent, thr).

    Ancestors that are near-duplicates of the node (Jaccard distance below `duplicate`) are passed by; one above max_tau is refused.
    """
    from tracelet.operators.trees import ancestors

    size = node_voxels.groupBy("node").agg(F.count("*").alias("n"))
    way = ancestors(tree.select(F.col("node").alias("id"), "parent")).filter("steps > 0").select(F.col("id").alias("node"), F.col("ancestor").alias("into"), "steps")
    sized = way.join(size, "node").join(size.select(F.col("node").alias("into"), F.col("n").alias("m")), "into").join(tree.select(F.col("node").alias("into"), "thr"), "into")
    # a node's voxels are among its ancestors', so the Jaccard index is the ratio of the sizes
    first = sized.filter(1 - F.col("n") / F.col("m") >= duplicate).groupBy("node").agg(F.min_by(F.struct("into", "thr", "n", "m"), "steps").alias("s"))
    return first.filter(F.col("s.thr") <= max_tau).select("node", "s.into", (F.col("s.n") / F.col("s.m")).alias("score"))


def suggest_split(merges: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, first, second, score) of nodes with two children: one less the larger of their merge scores."""
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("first"), F.max("node").alias("second"), F.count("*").alias("k")).filter("k = 2").drop("k")
    a = merges.select(F.col("node").alias("first"), F.col("into").alias("node"), F.col("score").alias("sa"))
    b = merges.select(F.col("node").alias("second"), F.col("into").alias("node"), F.col("score").alias("sb"))
    return kids.join(a, ["node", "first"]).join(b, ["node", "second"]).select("node", "first", "second", (1 - F.greatest("sa", "sb")).alias("score"))


def collapse_single_children(tree: DataFrame) -> DataFrame:
    """tree (id, parent, ...) without nodes that have one child; the child takes their place."""
    from tracelet.operators.trees import children_count, follow

    single = children_count(tree).filter("n_children = 1").select(F.col("id").alias("pid"))
    # a chain of single parents is gone through to its upper end, whose own parent takes the place
    to = follow(tree.join(single, F.col("parent") == F.col("pid"), "left").select("id", F.col("pid").alias("to")))
    up = tree.select(F.col("id").alias("end"), F.col("parent").alias("above"))
    rest = tree.join(single, F.col("id") == F.col("pid"), "left_anti").join(to.select("id", "end"), "id").join(up, "end")
    return rest.withColumn("parent", F.col("above")).select(tree.columns)


def splice_duplicates(tree: DataFrame, sizes: DataFrame, tau: float, duplicate: float = 0.1) -> DataFrame:
    """tree (id, parent, thr) below tau without nodes that are nearly their parent (Jaccard distance of their voxels below `duplicate`; sizes (id, n)): their children come to the parent, and their siblings head trees of their own."""
    from tracelet.operators.trees import follow

    n = sizes.select("id", "n")
    up = tree.select(F.col("id").alias("parent"), F.col("thr").alias("up")).join(n.select(F.col("id").alias("parent"), F.col("n").alias("m")), "parent")
    near = tree.join(n, "id").join(up, "parent").filter((F.col("up") < tau) & (1 - F.col("n") / F.col("m") < duplicate)).select("id", "parent")
    gone, split = near.select(F.col("id").alias("gid")), near.select(F.col("parent").alias("sid")).distinct()
    to = follow(tree.join(gone, F.col("id") == F.col("gid"), "left").select("id", F.when(F.col("gid").isNotNull(), F.col("parent")).alias("to"))).select(F.col("id").alias("parent"), "end")
    rest = tree.join(gone, F.col("id") == F.col("gid"), "left_anti").join(to, "parent", "left").join(split, F.col("parent") == F.col("sid"), "left")
    return rest.withColumn("parent", F.when(F.col("sid").isNull(), F.col("end"))).select(tree.columns)


def flood_object(voxels: DataFrame, seed: DataFrame, connectivity: int) -> DataFrame:
    """The voxels (voxel_id, x, y, z, ...) that hang together with those of seed (voxel_id)."""
    parts = _parts(voxels, connectivity)
    wanted = parts.join(seed, "voxel_id", "left_semi").select("part").distinct()
    return voxels.join(parts.join(wanted, "part", "left_semi").select("voxel_id"), "voxel_id", "left_semi")


def objects(voxels: DataFrame, connectivity: int) -> DataFrame:
    """(part, n, least and most of x, y, z) of all that hangs together; a part is named by its least voxel."""
    met = voxels.join(_parts(voxels, connectivity), "voxel_id")
    return met.groupBy("part").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("x", "y", "z") for f, name in ((F.min, "min"), (F.max, "max"))])


def _parts(voxels: DataFrame, connectivity: int) -> DataFrame:
    from tracelet.operators import graph
    from tracelet.operators.regions import shifted

    near = shifted(voxels.select("voxel_id", "x", "y", "z"), connectivity).select(F.col("voxel_id").alias("u"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))
    edges = near.join(voxels.select(F.col("voxel_id").alias("v"), "x", "y", "z"), ["x", "y", "z"]).select("u", "v")
    return graph.components(edges, voxels.select(F.col("voxel_id").alias("node"))).select(F.col("node").alias("voxel_id"), F.col("component").alias("part"))


def collapse_regions(edges: DataFrame, merge: Column) -> DataFrame:
    """(node, into): regions put together over the edges (u, v, ...) for which a rule on the edge holds, all at once; into is the least of them."""
    from tracelet.operators import graph

    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return graph.components(edges.filter(merge).select("u", "v"), nodes).select("node", F.col("component").alias("into"))


def merge_partition(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """labels (label, ...) under mapping (label, into); a label without one stays."""
    return labels.join(mapping, "label", "left").withColumn("label", F.coalesce("into", "label")).drop("into")


def geodesic_labels(voxels: DataFrame, seeds: DataFrame, connectivity: int) -> DataFrame:
    """(voxel_id, label, steps): each voxel's nearest seed (voxel_id) by steps through the voxels, ties to the smaller; null where none is reached."""
    from tracelet.operators import graph
    from tracelet.operators.regions import shifted

    near = shifted(voxels.select("voxel_id", "x", "y", "z"), connectivity).select(F.col("voxel_id").alias("u"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))
    edges = near.join(voxels.select(F.col("voxel_id").alias("v"), "x", "y", "z"), ["x", "y", "z"]).filter("u < v").select("u", "v", F.lit(1.0).alias("weight"))
    paths = graph.shortest_paths(edges, seeds.select(F.col("voxel_id").alias("node")))
    return voxels.select("voxel_id").join(paths.select(F.col("node").alias("voxel_id"), F.col("source").alias("label"), F.col("distance").cast("int").alias("steps")), "voxel_id", "left")


def relabel_dense(labels: DataFrame, min_size: int) -> DataFrame:
    """(frame, voxel_id, label) without labels of fewer than min_size voxels, numbered from 1 in each frame."""
    big = labels.filter("label > 0").groupBy("frame", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    dense = big.withColumn("new", F.row_number().over(Window.partitionBy("frame").orderBy("label"))).select("frame", "label", "new")
    return labels.join(dense, ["frame", "label"]).select("frame", "voxel_id", F.col("new").alias("label"))


def region_adjacency(labelled: DataFrame, connectivity: int) -> DataFrame:
    """(u, v, n_border): labels that touch, from rows (label, x, y, z)."""
    from tracelet.operators.regions import touching

    t = labelled.select(F.col("label").alias("sv_id"), "x", "y", "z")
    return touching(t, t, connectivity).filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"), "n_border")
