"""Rules on lineage forests that look at what lies beside a branch: touching branches, and what the neighbour of a dead node does.

Forests are as in trees: nodes (id, parent, frame, ...). Touches are (a, b, n_border) of nodes of a frame, either way round,
as touching_nodes makes them of regions. Neighbours are (a_id, b_id, rank) as the nearest-neighbour joins give them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelet.operators import trees

NO_NEIGHBOUR = 1.2  # a death ratio outside the range of the others
NEARLY = 1e-4


def touching_nodes(touches: DataFrame, owners: DataFrame) -> DataFrame:
    """(a, b, n_border) of nodes from those of regions: the longest border between a region of the one and one of the other. owners (sv_id, id)."""
    a = owners.select(F.col("sv_id").alias("a"), F.col("id").alias("ia"))
    b = owners.select(F.col("sv_id").alias("b"), F.col("id").alias("ib"))
    met = touches.join(a, "a").join(b, "b").filter("ia <> ib")
    return met.groupBy(F.col("ia").alias("a"), F.col("ib").alias("b")).agg(F.max("n_border").alias("n_border"))


def _stay_together(pairs: DataFrame, branched: DataFrame, touches: DataFrame, least: int) -> DataFrame:
    """Those of pairs (l_branch, r_branch) whose nodes touch in at least so many voxels in every step in which both have one child. One border row is enough for a step, so rows of touches may stand either way round."""
    steps = branched.filter("n_children = 1").select("branch", "place", "id")
    left = steps.select(F.col("branch").alias("l_branch"), "place", F.col("id").alias("l"))
    right = steps.select(F.col("branch").alias("r_branch"), "place", F.col("id").alias("r"))
    both = pairs.join(left, "l_branch").join(right, ["r_branch", "place"])
    close = touches.filter(F.col("n_border") >= least)
    close = close.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    apart = both.withColumn("lo", F.least("l", "r")).withColumn("hi", F.greatest("l", "r")).join(close, ["lo", "hi"], "left_anti")
    return pairs.join(apart.select("l_branch", "r_branch").distinct(), ["l_branch", "r_branch"], "left_anti")


def non_separating(nodes: DataFrame, touches: DataFrame, least: int = 1) -> DataFrame:
    """Divisions whose daughters never come apart before one of them ends or divides: (id, l_branch, r_branch), for trees.merge_daughters."""
    b = trees.branches(nodes)
    pairs = trees.daughters(b).select("id", "l_branch", "r_branch")
    return _stay_together(pairs, b, touches, least).select("id", "l_branch", "r_branch")


def short_lived_or_close(nodes: DataFrame, touches: DataFrame, length: int, max_frame: int, least: int = 1) -> DataFrame:
    """Divisions before max_frame to merge, by the short-lived rule or else for never coming apart: (id, l_branch, r_branch, rule)."""
    pairs = trees.daughters(trees.branches(nodes)).filter(F.col("frame") < max_frame)
    short = trees.merge_short_lived(pairs, length).withColumn("rule", F.lit("short-lived"))
    close = non_separating(nodes, touches, least).join(pairs.select("id"), "id", "left_semi").join(short, "id", "left_anti")
    return short.unionByName(close.withColumn("rule", F.lit("non-separating")))


def parallel_lineages(nodes: DataFrame, touches: DataFrame, least: int = 1) -> DataFrame:
    """Trees that begin in the same frame and stay together: (l_branch, r_branch), each root with the least other that will do."""
    b = trees.branches(nodes)
    first = nodes.filter("parent is null").select("id", "frame")
    close = touches.filter(F.col("n_border") >= least).select(F.least("a", "b").alias("l_branch"), F.greatest("a", "b").alias("r_branch")).distinct()
    pairs = close.join(first.select(F.col("id").alias("l_branch"), "frame"), "l_branch").join(first.select(F.col("id").alias("r_branch"), "frame"), ["r_branch", "frame"])
    kept = _stay_together(pairs.select("l_branch", "r_branch"), b, touches, least)
    return kept.groupBy("l_branch").agg(F.min("r_branch").alias("r_branch"))


def _deaths(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, near, near_frame) of nodes without children: their nearest neighbour, null without one."""
    dead = trees.children_count(nodes).filter("n_children = 0").select("id", "frame")
    return dead.join(neighbours.filter("rank = 1").select(F.col("a_id").alias("id"), F.col("b_id").alias("near")), "id", "left")


def neighbour_division(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, steps) of each death: frames until its nearest neighbour divides, negative if it dies first; null without a neighbour."""
    b = trees.branches(nodes)
    s = trees.branch_summary(b).select("branch", "length", "ends")
    ahead = b.join(s, "branch").select(F.col("id").alias("near"), (F.when(F.col("ends") == "death", -1).otherwise(1) * (F.col("length") - 1 - F.col("place"))).cast("long").alias("steps"))
    return _deaths(nodes, neighbours).join(ahead, "near", "left").select("id", "steps")


def death_then_division(nodes: DataFrame, neighbours: DataFrame, length: int) -> DataFrame:
    """(id) of deaths whose nearest neighbour divides within `length` frames: a node that two others took for one."""
    b = trees.branches(nodes)
    s = trees.branch_summary(b).filter("ends = 'division'").select("branch", "last_frame")
    ahead = b.join(s, "branch").select(F.col("id").alias("near"), "last_frame")
    return _deaths(nodes, neighbours).join(ahead, "near").filter(F.col("last_frame") - F.col("frame") <= length).select("id")


def _beside_deaths(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, near, child): deaths that have a neighbour, and each of its children, null without."""
    kids = nodes.filter("parent is not null").select(F.col("parent").alias("near"), F.col("id").alias("child"))
    return _deaths(nodes, neighbours).filter("near is not null").select("id", "near").join(kids, "near", "left")


def asked_overlaps(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(a, b): those rows of overlaps that death_ratio looks up."""
    met = _beside_deaths(nodes, neighbours).filter("child is not null")
    return met.select(F.explode(F.array("near", "id")).alias("a"), F.col("child").alias("b")).distinct()


def death_ratio(nodes: DataFrame, neighbours: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(id, ratio) of each death: (near - dead) / (near + 1e-4), where near and dead are the least Jaccard distances from the children of its nearest neighbour to that neighbour and to the dead node; over 0 the neighbour moved into its place.

    overlaps (a, b, jaccard) of nodes with nodes of the next frame, where those of asked_overlaps are enough; without one the
    distance is 1. Without a neighbour the ratio is 1.2.
    """
    d = _deaths(nodes, neighbours)
    o = overlaps.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    met = _beside_deaths(nodes, neighbours)
    for side, name in (("near", "jn"), ("id", "jd")):
        met = met.join(o.select(F.col("a").alias(side), F.col("b").alias("child"), F.col("jaccard").alias(name)), [side, "child"], "left")
    least = met.groupBy("id").agg(*[F.min(1 - F.coalesce(c, F.lit(0.0))).alias(c) for c in ("jn", "jd")])
    return d.select("id").join(least, "id", "left").select("id", F.coalesce((F.col("jn") - F.col("jd")) / (F.col("jn") + NEARLY), F.lit(NO_NEIGHBOUR)).alias("ratio"))


def displacement_overlap(nodes: DataFrame, shifted: DataFrame) -> DataFrame:
    """(id, distance): one less the Jaccard index of a node's region and its parent's after both are centred (shifted: a, b, jaccard, as regions.overlap_shifted gives it); 0 for roots and where it is missing."""
    j = shifted.select(F.col("a").alias("parent"), F.col("b").alias("id"), "jaccard")
    return nodes.select("id", "parent").join(j, ["parent", "id"], "left").select("id", F.coalesce(1 - F.col("jaccard"), F.lit(0.0)).alias("distance"))


def chain_frames(components: DataFrame) -> DataFrame:
    """A forest of frames of components (frame, position, parent, x, y, z, dead): (id, parent, frame, x, y, z, lineage).

    A component's parent is a position in the frame before; dead ones are left out, and what points at them or beyond the
    frame is an orphan, the root of a new lineage. Ids are dense from 0 in the order of frame and position; a lineage is
    named by its root.
    """
    counted = components.filter("not dead").groupBy("frame").agg(F.count("*").alias("k"))
    every = counted.agg(F.collect_list(F.struct("frame", "k")).alias("every"))  # a row for each frame
    start = counted.crossJoin(every).select("frame", F.aggregate(F.filter("every", lambda e: e["frame"] < F.col("frame")), F.lit(0).cast("long"), lambda s, e: s + e["k"]).alias("start"))
    order = F.row_number().over(Window.partitionBy("frame").orderBy("position")) - 1
    alive = components.filter("not dead").withColumn("turn", order).join(start, "frame").withColumn("id", (F.col("start") + F.col("turn")).cast("long"))
    up = alive.select((F.col("frame") + 1).alias("frame"), F.col("position").alias("parent"), F.col("id").alias("up"))
    nodes = alive.join(up, ["frame", "parent"], "left").select("id", F.col("up").alias("parent"), "frame", "x", "y", "z")
    return nodes.join(trees.roots(nodes).select("id", F.col("root").alias("lineage")), "id")


def regions_of_lineage(nodes: DataFrame, owners: DataFrame, first: int, last: int) -> DataFrame:
    """(root, frame, sv_id): the regions of each tree's nodes between two frames, both included."""
    r = trees.roots(nodes).select("id", "root")
    return nodes.filter(F.col("frame").between(first, last)).join(r, "id").join(owners, "id").select("root", "frame", "sv_id")


def near_duplicates(regions: DataFrame, neighbours: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, n): regions with others of the same frame and size nearer than `least` squared: how many. regions (id, frame, n); neighbours (a_id, b_id, d2)."""
    a = regions.select(F.col("id").alias("a_id"), F.col("n").alias("na"))
    b = regions.select(F.col("id").alias("b_id"), F.col("n").alias("nb"))
    met = neighbours.filter((F.col("d2") < least) & (F.col("a_id") != F.col("b_id"))).join(a, "a_id").join(b, "b_id").filter("na = nb")
    return met.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"))


def shared_owners(owners: DataFrame) -> DataFrame:
    """(id, n): nodes that own more than one region."""
    return owners.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def tree_extent(nodes: DataFrame) -> DataFrame:
    """(root, n, path, least and most of x, y, z): box and total length of each tree."""
    r = trees.roots(nodes).select("id", "root")
    moved = nodes.select("id", *trees.AXES).join(trees.displacement(nodes).select("id", "d2"), "id", "left").join(r, "id")
    box = [f(c).alias(f"{name}_{c}") for c in trees.AXES for f, name in ((F.min, "min"), (F.max, "max"))]
    return moved.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.sqrt(F.coalesce("d2", F.lit(0.0)))).alias("path"), *box)


def clip_trees(nodes: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """The nodes within a box, borders included; where the parent is outside, they are roots."""
    inside = [F.col(c).between(a, b) for c, a, b in zip(trees.AXES, low, high)]
    return trees.repaired(nodes.filter(inside[0] & inside[1] & inside[2]))


# dendrograms: nodes (id, parent, thr), leaves with n voxels


def leaves_below(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, n_leaves, n): leaves at or below each node of a dendrogram, and their voxels; sizes (id, n) of leaves."""
    own = nodes.select("id", "parent").join(sizes.select("id", F.col("n").cast("long").alias("n"), F.lit(1).cast("long").alias("n_leaves")), "id", "left").na.fill(0, ["n", "n_leaves"])
    return trees.subtree_totals(own, ("n_leaves", "n"))


def persistent_leaves(nodes: DataFrame, tau: float) -> DataFrame:
    """(id) of leaves whose parent merges at tau or above."""
    up = nodes.select(F.col("id").alias("parent"), F.col("thr").alias("up"))
    return trees.children_count(nodes).filter("n_children = 0").join(up, "parent").filter(F.col("up") >= tau).select("id")


def realistic_nodes(nodes: DataFrame, sizes: DataFrame, tau: float, least: int) -> DataFrame:
    """(id) of nodes that may stand for an object: below tau, and of more than `least` voxels if a leaf, else with a child of more."""
    n = leaves_below(nodes, sizes).select("id", "n")
    kids = nodes.select("id", "parent").join(n, "id").groupBy(F.col("parent").alias("id")).agg(F.max("n").alias("largest"))
    all_ = nodes.join(n, "id", "left").join(kids, "id", "left")
    return all_.filter((F.col("thr") < tau) & (F.coalesce("largest", "n") > least)).select("id")


def dendrogram_faults(nodes: DataFrame) -> DataFrame:
    """(rule, n): how many nodes break each rule of a dendrogram: one root, no or two children, no child above its parent."""
    kids = trees.children_count(nodes)
    up = nodes.select(F.col("id").alias("parent"), F.col("thr").alias("up"))
    found = [
        ("further roots", nodes.filter("parent is null").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n"))),
        ("not two children", kids.filter("n_children not in (0, 2)").agg(F.count("*").alias("n"))),
        ("above its parent", nodes.join(up, "parent").filter("thr > up").agg(F.count("*").alias("n"))),
    ]
    out = None
    for rule, row in found:
        row = row.select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionAll(row)
    return out
