"""Lineage forests: nodes (id, parent, frame, ...), at most two children a node.

Walks along paths are pointer doublings: each round joins a node's pointer with
the pointer of what it points at, so a path of n nodes takes log2 n equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.geometry import ISOTROPIC, division_plane_distance, squared_distance
from tracelet.plans.durable import durable

AXES = ("x", "y", "z")
CUT_EVERY = 5


def repaired(nodes: DataFrame) -> DataFrame:
    """nodes with a null parent where the parent isn't among them."""
    ids = nodes.select(F.col("id").alias("pid"))
    return nodes.join(ids, F.col("parent") == F.col("pid"), "left").withColumn("parent", F.col("pid")).drop("pid")


def children_count(nodes: DataFrame) -> DataFrame:
    """nodes with n_children."""
    n = nodes.filter("parent is not null").groupBy(F.col("parent").alias("pid")).agg(F.count("*").alias("n_children"))
    return nodes.join(n, F.col("id") == F.col("pid"), "left").drop("pid").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def follow(pointers: DataFrame) -> DataFrame:
    """From (id, to), to null at an end: (id, end, steps) of the whole way. The pointers must not form a circle."""
    now = durable(pointers.select("id", F.coalesce("to", "id").alias("end"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    rounds = 0
    while True:
        ahead = now.select(F.col("id").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("steps2"))
        new = now.join(ahead, "end", "left").select("id", F.coalesce("end2", "end").alias("end"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
        new = durable(new)
        moved = new.join(now.withColumnRenamed("end", "old"), "id").filter("end <> old").isEmpty()
        now, rounds = new, rounds + 1
        if moved:
            return now
        if rounds > 62:
            raise ValueError("the parents form a circle")


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root, depth)."""
    return follow(nodes.select("id", F.col("parent").alias("to"))).select("id", F.col("end").alias("root"), F.col("steps").alias("depth"))


def ancestor_at(nodes: DataFrame, frame: int) -> DataFrame:
    """(id, ancestor): the first ancestor, itself included, at or before a frame; the root if all are later."""
    return follow(nodes.select("id", F.when(F.col("frame") > frame, F.col("parent")).alias("to"))).select("id", F.col("end").alias("ancestor"))


def ancestors(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(id, ancestor, steps), itself with 0, up to `most` steps: a row for each node and step, so without a bound as many as the sum of the depths. By doubling."""
    pairs = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    jump, reach = _jumps(nodes), 1
    while (most is None or reach <= most) and not jump.isEmpty():
        up = jump.select(F.col("id").alias("ancestor"), F.col("to").alias("higher"))
        further = pairs.join(up, "ancestor").select("id", F.col("higher").alias("ancestor"), (F.col("steps") + reach).alias("steps"))
        pairs = durable(pairs.union(further if most is None else further.filter(F.col("steps") <= most)))
        jump, reach = _farther(jump), 2 * reach
    return pairs


def _jumps(nodes: DataFrame) -> DataFrame:
    return durable(nodes.filter("parent is not null").select("id", F.col("parent").alias("to")))


def _farther(jump: DataFrame) -> DataFrame:
    """Pointers (id, to) of twice the reach; those that would pass the root go."""
    return durable(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))


def subtree_totals(nodes: DataFrame, sums: Sequence[str] = (), tops: Sequence[str] = ()) -> DataFrame:
    """(id, ...): columns summed, or their largest, over the nodes at and below each. nodes (id, parent, ...).

    By doubling: what lies within 2k steps below a node is what lies within k steps below it and below the nodes that are k
    steps under it. So a round has a row a node, whatever the depth.
    """
    names = [*sums, *tops]
    now, jump = durable(nodes.select("id", *names)), _jumps(nodes)
    while not jump.isEmpty():
        more = jump.join(now, "id").groupBy(F.col("to").alias("id")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums], *[F.max(c).alias(f"more_{c}") for c in tops])
        both = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums] + [F.greatest(c, f"more_{c}").alias(c) for c in tops]
        now = durable(now.join(more, "id", "left").select("id", *both))
        jump = _farther(jump)
    return now


def topmost(nodes: DataFrame) -> DataFrame:
    """(id, top): of nodes (id, parent, marked), the marked one nearest the root among a node and those above it; null without one. By doubling."""
    now, jump = durable(nodes.select("id", F.when(F.col("marked"), F.col("id")).alias("top"))), _jumps(nodes)
    while not jump.isEmpty():
        above = jump.join(now.select(F.col("id").alias("to"), F.col("top").alias("higher")), "to").select("id", "higher")
        now = durable(now.join(above, "id", "left").select("id", F.coalesce("higher", "top").alias("top")))
        jump = _farther(jump)
    return now


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(id, n_nodes, n_leaves, last_frame) of the nodes at and below each."""
    own = children_count(nodes).select("id", "parent", F.lit(1).cast("long").alias("n_nodes"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("frame").alias("last_frame"))
    return subtree_totals(own, ("n_nodes", "n_leaves"), ("last_frame",))


def breadth_first(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, position): position from 0 in each tree, by depth, then id."""
    order = Window.partitionBy("root").orderBy("depth", "id")
    return roots(nodes).withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def branches(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, branch (its first node's id) and place from 0. A branch is a longest chain in which each parent has one child."""
    n = durable(children_count(nodes))
    single = n.filter("n_children = 1").select(F.col("id").alias("pid"))
    heads = follow(n.join(single, F.col("parent") == F.col("pid"), "left").select("id", F.col("pid").alias("to")))
    return n.join(heads.select("id", F.col("end").alias("branch"), F.col("steps").alias("place")), "id")


def branch_summary(branched: DataFrame) -> DataFrame:
    """(branch, length, parent, first_frame, last_id, last_frame, ends): ends is 'death' or 'division'."""
    last = F.max(F.struct("place", F.col("id").alias("last_id"), F.col("frame").alias("last_frame"), "n_children"))
    first = F.min(F.struct("place", "parent", F.col("frame").alias("first_frame")))
    s = branched.groupBy("branch").agg(F.count("*").alias("length"), last.alias("l"), first.alias("f"))
    return s.select("branch", "length", "f.parent", "f.first_frame", "l.last_id", "l.last_frame", F.when(F.col("l.n_children") == 0, "death").otherwise("division").alias("ends"))


def daughters(branched: DataFrame) -> DataFrame:
    """Of each division: id, frame, and of its left (smaller id) and right daughter's branch l_/r_ branch, length, ends, last_frame."""
    s = branch_summary(branched)
    pair = s.filter("parent is not null").groupBy("parent").agg(F.min("branch").alias("l"), F.max("branch").alias("r")).filter("l <> r")
    out = pair.withColumnRenamed("parent", "id")
    for side in ("l", "r"):
        own = s.select(F.col("branch").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("branch", "length", "ends", "last_frame")])
        out = out.join(own, side).drop(side)
    return out.join(branched.select("id", "frame"), "id")


def length_to_death(pairs: DataFrame) -> DataFrame:
    """(id, length): the shorter run of the daughters that die; -1 if both divide."""
    left, right = [F.when(F.col(f"{s}_ends") == "death", F.col(f"{s}_length")) for s in "lr"]
    return pairs.select("id", F.coalesce(F.least(left, right), F.lit(-1)).cast("long").alias("length"))


def length_to_division(pairs: DataFrame) -> DataFrame:
    """(id, l_length, r_length): each daughter's run, negative if it ends in death."""
    return pairs.select("id", *[(F.when(F.col(f"{s}_ends") == "death", -1).otherwise(1) * F.col(f"{s}_length")).cast("long").alias(f"{s}_length") for s in "lr"])


def short_lived(pairs: DataFrame, length: int) -> DataFrame:
    """Divisions with a daughter that dies within `length` frames: (id, delete): the left one's branch if it dies, else the right one's."""

    def dies(s: str) -> Column:
        return (F.col(f"{s}_ends") == "death") & (F.col(f"{s}_last_frame") - F.col("frame") <= length)

    # a daughter is looked at until its frame is `length` past the division, so a run that ends there counts
    return pairs.select("id", F.when(dies("l"), F.col("l_branch")).when(dies("r"), F.col("r_branch")).alias("delete")).filter("delete is not null")


def delete_subtrees(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """nodes without those at or below tops (id)."""
    marked = nodes.select("id", "parent").join(tops.select("id", F.lit(True).alias("marked")).distinct(), "id", "left")
    return nodes.join(topmost(marked).filter("top is not null").select("id"), "id", "left_anti")


def delete_short_lived(nodes: DataFrame, length: int, max_frame: int) -> DataFrame:
    """nodes after the rule on all divisions before max_frame, all judged on the given forest. What one deletion opens, a further call sees."""
    tops = short_lived(daughters(branches(nodes)).filter(F.col("frame") < max_frame), length).select(F.col("delete").alias("id"))
    return delete_subtrees(nodes, tops)


def merge_daughters(nodes: DataFrame, divisions: DataFrame) -> DataFrame:
    """(id, into): nodes of the right daughter's branch that the left one's node of the same frame takes over, for divisions with l_branch, r_branch. Later ones go on as the left one's tail."""
    b = branches(nodes).select("id", "branch", "frame")
    pairs = divisions.select("l_branch", "r_branch")
    left = pairs.join(b.select(F.col("branch").alias("l_branch"), F.col("id").alias("into"), "frame"), "l_branch")
    right = pairs.join(b.select(F.col("branch").alias("r_branch"), "id", "frame"), "r_branch").select("r_branch", "id", "frame")
    return left.join(right, ["r_branch", "frame"]).select("id", "into")


def merge_short_lived(pairs: DataFrame, length: int) -> DataFrame:
    """Divisions both of whose daughters have at most one child between their ends within `length` frames, and so merge: (id, l_branch, r_branch)."""

    def children(s: str) -> Column:
        """Of the node where the walk stops: at the run's end, or when it is `length` frames old."""
        past = F.col(f"{s}_last_frame") - F.col("frame") > length
        return F.when(past, 1).when(F.col(f"{s}_ends") == "death", 0).otherwise(2)

    return pairs.filter(children("l") + children("r") <= 1).select("id", "l_branch", "r_branch")


def dead_lineages(nodes: DataFrame, max_frame: int) -> DataFrame:
    """(root): trees whose first branch ends in death before max_frame."""
    s = branch_summary(branches(nodes))
    return s.filter((F.col("parent").isNull()) & (F.col("ends") == "death") & (F.col("last_frame") < max_frame)).select(F.col("branch").alias("root"))


def short_background_lineages(nodes: DataFrame, max_length: int, max_frame: int, threshold: float) -> DataFrame:
    """(root): short dead trees without division all of whose nodes score at least the threshold."""
    b = branches(nodes)
    s = branch_summary(b).filter(F.col("parent").isNull() & (F.col("ends") == "death") & (F.col("last_frame") < max_frame) & (F.col("length") <= max_length))
    sure = b.groupBy("branch").agg(F.min("score").alias("least")).filter(F.col("least") >= threshold)
    return s.join(sure, "branch", "left_semi").select(F.col("branch").alias("root"))


def division_plane(nodes: DataFrame, threshold: float, scale: Sequence[float] = ISOTROPIC) -> DataFrame:
    """Of each division (id, distance, rejected, cut): the mother's distance from the plane between her daughters; if it is over the threshold, cut is the farther daughter, the left one on a tie."""
    kids = nodes.filter("parent is not null").select("parent", F.struct("id", *AXES).alias("k"))
    pair = kids.groupBy("parent").agg(F.min("k").alias("l"), F.max("k").alias("r")).filter("l.id <> r.id")
    p = pair.join(nodes.select(F.col("id").alias("parent"), *AXES), "parent")
    me, left, right = [[F.col(f"{s}{c}") for c in AXES] for s in ("", "l.", "r.")]
    d = division_plane_distance(me, left, right, scale)
    far = F.when(squared_distance(me, left, scale) >= squared_distance(me, right, scale), F.col("l.id")).otherwise(F.col("r.id"))
    return p.select(F.col("parent").alias("id"), d.alias("distance"), F.coalesce(d > threshold, F.lit(False)).alias("rejected"), F.when(d > threshold, far).alias("cut"))


def break_divisions(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """nodes with the parents of cuts (cut) set to null, each the root of a new tree."""
    c = cuts.filter("cut is not null").select(F.col("cut").alias("id"), F.lit(True).alias("gone"))
    return nodes.join(c, "id", "left").withColumn("parent", F.when(F.col("gone"), None).otherwise(F.col("parent"))).drop("gone")


def branch_max(branched: DataFrame, threshold: float) -> DataFrame:
    """(id, branch_score, kept): each node takes its branch's largest score; kept below the threshold."""
    m = F.max("score").over(Window.partitionBy("branch"))
    return branched.select("id", m.alias("branch_score")).withColumn("kept", F.col("branch_score") < threshold)


def branch_mean(branched: DataFrame, threshold: float) -> DataFrame:
    """(id, branch_score, kept): with the branch's mean score, its first node included."""
    m = F.avg("score").over(Window.partitionBy("branch"))
    return branched.select("id", m.alias("branch_score")).withColumn("kept", F.col("branch_score") < threshold)


def hysteresis(branched: DataFrame, low: float, high: float) -> DataFrame:
    """(id, score, raised, kept): within a branch a run of nodes above low that holds one above high takes the largest score up to each node from the one above high: the running maximum down the run, then up it.

    A null or negative score is unknown: it takes the next known one of its branch, and stays unknown without one. Kept below high.
    """
    way = Window.partitionBy("branch").orderBy("place")
    known = F.when(F.col("score") >= 0, F.col("score"))
    s = branched.select("id", "branch", "place", F.coalesce(known, F.first(known, ignorenulls=True).over(way.rowsBetween(0, Window.unboundedFollowing))).alias("score"))
    s = s.withColumn("run", F.sum(F.when(F.col("score") > low, 0).otherwise(1)).over(way)).withColumn("inside", F.col("score") > low)
    run = Window.partitionBy("branch", "run", "inside").orderBy("place")
    top = F.max("score").over(run)
    down = F.when(F.col("inside") & (top > high), top).otherwise(F.col("score"))
    s = s.withColumn("down", down)
    back = F.max("down").over(Window.partitionBy("branch", "run", "inside").orderBy(F.desc("place")))
    raised = F.when(F.col("inside") & (back > high), back).otherwise(F.col("down"))
    return s.select("id", "score", raised.alias("raised")).withColumn("kept", F.coalesce(F.col("raised") < high, F.lit(True)))


def renumber(nodes: DataFrame) -> DataFrame:
    """(id, new_id, frame): dense from 0 within each frame, in id order."""
    return nodes.select("id", (F.row_number().over(Window.partitionBy("frame").orderBy("id")) - 1).cast("long").alias("new_id"), "frame")


def confidence(nodes: DataFrame, threshold: float, scale: Sequence[float] = ISOTROPIC) -> DataFrame:
    """(id, confidence): 3 with exactly one child, a parent (or in frame 0) and a squared displacement of at most the threshold; else 0."""
    n = children_count(nodes)
    p = nodes.select(F.col("id").alias("parent"), *[F.col(c).alias(f"p{c}") for c in AXES])
    d2 = squared_distance([F.col(c) for c in AXES], [F.col(f"p{c}") for c in AXES], scale)
    fine = (F.col("n_children") == 1) & F.when(F.col("px").isNull(), F.col("frame") == 0).otherwise(d2 <= threshold)
    return n.join(p, "parent", "left").select("id", F.when(fine, 3).otherwise(0).alias("confidence"))


def displacement(nodes: DataFrame, scale: Sequence[float] = ISOTROPIC) -> DataFrame:
    """(id, frame, d2) of nodes with a parent."""
    p = nodes.select(F.col("id").alias("parent"), *[F.col(c).alias(f"p{c}") for c in AXES])
    return nodes.join(p, "parent").select("id", "frame", squared_distance([F.col(c) for c in AXES], [F.col(f"p{c}") for c in AXES], scale).alias("d2"))


def displacement_threshold(moves: DataFrame, least: int = 30, widths: float = 4.0, surely: float = 6.25) -> DataFrame:
    """By frame (frame, n, threshold, n_large): (median + widths * 1.4826 * MAD) squared of the displacements; n_large exceed it `surely` times. Null up to `least` moves. The median is the upper middle value."""

    def middle(c: str) -> Column:
        a = F.sort_array(F.collect_list(c))
        return F.get(a, F.floor(F.count(c) / 2).cast("int"))

    d = moves.select("frame", F.sqrt("d2").alias("d"))
    med = d.groupBy("frame").agg(middle("d").alias("med"))
    gap = d.join(med, "frame").select("frame", "med", "d", F.abs(F.col("d") - F.col("med")).alias("gap"))
    mad = gap.groupBy("frame", "med").agg(middle("gap").alias("mad"), F.count("*").alias("n"))
    side = F.col("med") + widths * 1.4826 * F.col("mad")
    t = mad.select("frame", "n", F.when(F.col("n") > least, side * side).alias("threshold"))
    over = d.join(t, "frame").filter(F.col("d") * F.col("d") > surely * F.col("threshold")).groupBy("frame").agg(F.count("*").alias("n_large"))
    return t.join(over, "frame", "left").select("frame", "n", "threshold", F.coalesce("n_large", F.lit(0).cast("long")).alias("n_large"))


def cut_sublineages(nodes: DataFrame, tops: DataFrame, frames: int) -> DataFrame:
    """The subtrees of tops (id) for so many frames, each with its top, frames counted from it: nodes with top and frame re-based."""
    t = tops.select(F.col("id").alias("ancestor")).distinct().join(nodes.select(F.col("id").alias("ancestor"), F.col("frame").alias("first")), "ancestor")
    got = ancestors(nodes, frames - 1).select("id", "ancestor").join(t, "ancestor").join(nodes, "id").filter(F.col("frame") < F.col("first") + frames)
    return got.withColumn("parent", F.when(F.col("id") == F.col("ancestor"), None).otherwise(F.col("parent"))).withColumn("frame", F.col("frame") - F.col("first")).withColumnRenamed("ancestor", "top").drop("first")


def paste_sublineages(nodes: DataFrame, edited: DataFrame, frames: int) -> DataFrame:
    """nodes with the cut subtrees replaced by edited ones (as cut_sublineages gives them, ids of the top kept)."""
    tops = edited.select(F.col("top").alias("id")).distinct()
    gone = cut_sublineages(nodes, tops, frames).select("id").distinct()
    first = nodes.select(F.col("id").alias("top"), F.col("frame").alias("first"), F.col("parent").alias("above"))
    back = edited.join(first, "top").withColumn("frame", F.col("frame") + F.col("first")).withColumn("parent", F.when(F.col("id") == F.col("top"), F.col("above")).otherwise(F.col("parent")))
    return repaired(nodes.join(gone, "id", "left_anti").unionByName(back.select(nodes.columns)))


def evict(nodes: DataFrame, frame: int) -> DataFrame:
    """nodes from a frame on; those of that frame are roots."""
    return nodes.filter(F.col("frame") >= frame).withColumn("parent", F.when(F.col("frame") > frame, F.col("parent")))


def insert_children(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with those of new whose parent has a free place, in id order."""
    taken = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("taken"))
    room = new.join(taken, "parent", "left").withColumn("turn", F.row_number().over(Window.partitionBy("parent").orderBy("id")))
    fits = room.filter(F.col("parent").isNull() | (F.coalesce("taken", F.lit(0)) + F.col("turn") <= 2))
    return nodes.unionByName(fits.select(nodes.columns))


def integrity(nodes: DataFrame) -> DataFrame:
    """(rule, n): how many nodes break each rule of a lineage forest."""
    kids = nodes.filter("parent is not null").groupBy("parent").count()
    p = nodes.select(F.col("id").alias("parent"), F.col("frame").alias("pframe"))
    linked = nodes.filter("parent is not null").join(p, "parent", "left")
    found = [
        ("duplicate id", nodes.groupBy("id").count().filter("count > 1")),
        ("more than two children", kids.filter("count > 2")),
        ("missing parent", linked.filter("pframe is null")),
        ("parent not one frame before", linked.filter("pframe is not null and frame <> pframe + 1")),
    ]
    out = None
    for rule, bad in found:
        row = bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def cut_at(nodes: DataFrame, tau: float) -> DataFrame:
    """Dendrogram (id, parent, thr) cut at tau: (leaf, node): the first node on the way from a root to each leaf with thr <= tau, or the leaf."""
    top = topmost(nodes.select("id", "parent", (F.col("thr") <= tau).alias("marked")))
    leaves = children_count(nodes).filter("n_children = 0").select("id")
    return top.join(leaves, "id").select(F.col("id").alias("leaf"), F.coalesce("top", "id").alias("node"))


def extend_dead(nodes: DataFrame, owners: DataFrame, overlaps: DataFrame, frame: int) -> DataFrame:
    """How nuclei of a frame without child may go on: (id, sv_id, score, owner).

    Each takes the region of the next frame that its own regions (owners: sv_id, id) overlap most (overlaps: a, b,
    n_common), ties to the smaller. A free region goes to the nucleus that overlaps it most; an owned one is named with its
    owner, for assign.assign to settle between the two.
    """
    dead = children_count(nodes).filter((F.col("n_children") == 0) & (F.col("frame") == frame)).select("id")
    met = overlaps.join(owners.select(F.col("sv_id").alias("a"), "id"), "a").join(dead, "id").groupBy("id", "b").agg(F.sum("n_common").alias("score"))
    best = met.groupBy("id").agg(F.max(F.struct("score", (-F.col("b")).alias("m"))).alias("t")).select("id", (-F.col("t.m")).alias("sv_id"), "t.score")
    held = best.join(owners.select("sv_id", F.col("id").alias("owner")), "sv_id", "left")
    first = F.row_number().over(Window.partitionBy("sv_id").orderBy(F.desc("score"), "id"))
    return held.withColumn("turn", first).filter(F.col("owner").isNotNull() | (F.col("turn") == 1)).select("id", "sv_id", "score", "owner")


def extend_dead_with_halves(nodes: DataFrame, owners: DataFrame, overlaps: DataFrame, halves: DataFrame, frame: int, better: float = 0.1) -> DataFrame:
    """extend_dead, but where a half of the region that a dead nucleus would take fits it better by `better` in Jaccard distance, that half: (id, sv_id, score, owner, half).

    overlaps (a, b, n_common, jaccard); halves (sv_id, half, a, jaccard): how like each half is to a region.
    """
    taken = extend_dead(nodes, owners, overlaps, frame)
    mine = owners.select(F.col("sv_id").alias("a"), "id")
    whole = overlaps.join(mine, "a").groupBy("id", F.col("b").alias("sv_id")).agg(F.max("jaccard").alias("whole"))
    part = halves.join(mine, "a").groupBy("id", "sv_id").agg(F.max(F.struct("jaccard", (-F.col("half")).alias("m"))).alias("h"))
    fits = taken.join(whole, ["id", "sv_id"], "left").join(part, ["id", "sv_id"], "left")
    return fits.select("id", "sv_id", "score", "owner", F.when(F.col("h.jaccard") > F.coalesce("whole", F.lit(0.0)) + better, -F.col("h.m")).alias("half"))


def event_neighbourhoods(nodes: DataFrame, neighbours: DataFrame, radius: int) -> DataFrame:
    """(event, id): nodes within `radius` steps up or down of each death (before the last frame) and division, with the nearest neighbours (a_id, b_id) of those nodes; taken up again through neighbours until nothing is added."""
    last = nodes.agg(F.max("frame")).collect()[0][0]
    n = children_count(nodes)
    events = n.filter((F.col("n_children") == 2) | ((F.col("n_children") == 0) & (F.col("frame") < last))).select(F.col("id").alias("event"))
    way = ancestors(nodes, radius).select("id", "ancestor")
    linked = durable(way.union(way.select(F.col("ancestor").alias("id"), F.col("id").alias("ancestor"))).distinct())
    got = durable(events.join(linked, F.col("event") == F.col("id")).select("event", F.col("ancestor").alias("id")).distinct())
    fresh = got
    while not fresh.isEmpty():
        near = fresh.join(neighbours.select(F.col("a_id").alias("id"), "b_id"), "id").select("event", F.col("b_id").alias("id")).distinct()
        fresh = durable(near.join(got, ["event", "id"], "left_anti"))
        got = durable(got.union(fresh))
    return got


def separated_parts(owners: DataFrame, touches: DataFrame, least_border: int) -> DataFrame:
    """(id, sv_id, part, n_parts): the connected parts of each nucleus' regions (owners: sv_id, id), where two regions hang together if they touch (a, b, n_border) in at least so many voxels. A part is named by its least region."""
    from tracelet.operators import graph

    a = owners.select(F.col("sv_id").alias("a"), F.col("id").alias("ia"))
    b = owners.select(F.col("sv_id").alias("b"), F.col("id").alias("ib"))
    edges = touches.filter(F.col("n_border") >= least_border).join(a, "a").join(b, "b").filter("ia = ib").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = graph.components(edges, owners.select(F.col("sv_id").alias("node"))).select(F.col("node").alias("sv_id"), F.col("component").alias("part"))
    n = owners.join(parts, "sv_id")
    return n.join(n.groupBy("id").agg(F.count_distinct("part").alias("n_parts")), "id").select("id", "sv_id", "part", "n_parts")


def detect_divisions(nodes: DataFrame, parts: DataFrame, centroids: DataFrame, scale: Sequence[float] = ISOTROPIC) -> DataFrame:
    """(id, part, role) of nuclei in several parts: role is 'first' (the daughter that keeps the node), 'second' or 'birth'.

    centroids (part, x, y, z). Of two parts the second is the sister. Of more, the pair whose division plane passes nearest to
    the parent are the daughters (ties to the smaller parts), the rest births; without a parent the first part stays and the
    rest are births. A node whose parent already has two children is left alone.
    """
    kids = children_count(nodes).select(F.col("id").alias("parent"), "n_children")
    open_ = nodes.join(kids, "parent", "left").filter(F.coalesce("n_children", F.lit(0)) < 2).select("id", "parent")
    p = parts.filter("n_parts > 1").select("id", "part", "n_parts").distinct().join(open_, "id").join(centroids.withColumnsRenamed({c: f"p{c}" for c in AXES}), "part")
    up = nodes.select(F.col("id").alias("parent"), *AXES)
    other = p.select("id", F.col("part").alias("part2"), *[F.col(f"p{c}").alias(f"q{c}") for c in AXES])
    pairs = p.join(other, "id").filter("part < part2").join(up, "parent")
    d = division_plane_distance([F.col(c) for c in AXES], [F.col(f"p{c}") for c in AXES], [F.col(f"q{c}") for c in AXES], scale)
    best = pairs.groupBy("id").agg(F.min(F.struct(F.coalesce(d, F.lit(float("inf"))).alias("d"), "part", "part2")).alias("b")).select("id", "b.part2", F.col("b.part").alias("part1"))
    least = p.groupBy("id").agg(F.min("part").alias("least"), F.min(F.struct("n_parts")).alias("k"))
    r = p.select("id", "part", "parent").join(best, "id", "left").join(least, "id")
    second = F.when((F.col("k.n_parts") == 2) & F.col("part1").isNull(), F.lit(None)).otherwise(F.col("part2"))
    role = F.when(F.col("part") == F.coalesce("part1", "least"), "first").when(F.col("part") == second, "second").when(F.col("part1").isNull() & (F.col("k.n_parts") == 2), "second").otherwise("birth")
    return r.select("id", "part", role.alias("role"))
