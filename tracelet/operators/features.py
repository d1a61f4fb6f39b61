"""Features of nuclei and of lineage windows, boosted trees, scores and their calibration."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.operators import trees

AXES = ("x", "y", "z")
SERIES = ("size", "intensity", "compactness", "displacement2")


def nucleus_features(nodes: DataFrame, shapes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, size, intensity, compactness, displacement2, knn_ratio): displacement2 is 0 for a root; knn_ratio is the nearest over the farthest known neighbour distance.

    nodes (id, parent, frame, x, y, z), shapes (id, size, intensity, compactness), neighbours (a_id, b_id, d2).
    """
    moves = trees.displacement(nodes).select("id", F.col("d2").alias("displacement2"))
    near = neighbours.groupBy(F.col("a_id").alias("id")).agg(F.try_divide(F.min("d2"), F.max("d2")).alias("knn_ratio"))
    out = nodes.select("id").join(shapes, "id", "left").join(moves, "id", "left").join(near, "id", "left")
    return out.select("id", "size", "intensity", "compactness", F.coalesce("displacement2", F.lit(0.0)).alias("displacement2"), "knn_ratio")


def window_features(nodes: DataFrame, features: DataFrame, frames: int) -> DataFrame:
    """By node, over the tree from it for so many frames: (id, n_nodes, n_divisions, length_share, and mean and variance of the relative change from parent to child of each series, mean_knn_ratio).

    Means and variances are of the changes whose parent value isn't 0; null without any.
    """
    reach = trees.ancestors(nodes, frames - 1)
    n = trees.children_count(nodes).select("id", "parent", "n_children")
    own = n.join(features, "id", "left")
    before = features.select(F.col("id").alias("parent"), *[F.col(s).alias(f"p_{s}") for s in SERIES])
    change = own.join(before, "parent", "left").select("id", "n_children", "knn_ratio", *[F.try_divide(F.col(s) - F.col(f"p_{s}"), F.col(f"p_{s}")).alias(f"c_{s}") for s in SERIES])
    met = reach.join(change, "id")
    inside = lambda s: F.when(F.col("steps") > 0, F.col(f"c_{s}"))  # noqa: E731  a change into the window's first node is outside it
    aggregates = [F.count("*").alias("n_nodes"), F.sum((F.col("n_children") == 2).cast("long")).alias("n_divisions"), ((F.max("steps") + 1) / frames).alias("length_share"), F.avg("knn_ratio").alias("mean_knn_ratio")]
    for s in SERIES:
        aggregates += [F.avg(inside(s)).alias(f"mean_{s}"), F.var_samp(inside(s)).alias(f"var_{s}")]
    return met.groupBy(F.col("ancestor").alias("id")).agg(*aggregates)


def background_score(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, score): its own (id, score), else its parent's, else -1."""
    s = nodes.select("id", "parent").join(scores, "id", "left")
    p = scores.select(F.col("id").alias("parent"), F.col("score").alias("p"))
    return s.join(p, "parent", "left").select("id", F.coalesce("score", "p", F.lit(-1.0)).alias("score"))


MODEL = "tree int, node int, feature int, th double, value double, gt int, le int"


def boosting_score(samples: DataFrame, model: list[tuple], features: str = "features") -> DataFrame:
    """samples with score: the sum over trees of the value of the leaf that a sample reaches. model: rows (tree, node, feature, th, value, gt, le); node 0 is a root, a leaf has feature -1. Compiled to one expression."""
    by_tree: dict[int, dict[int, tuple]] = {}
    for tree, node, feature, th, value, gt, le in model:
        by_tree.setdefault(tree, {})[node] = (feature, th, value, gt, le)

    def walk(nodes: dict[int, tuple], at: int) -> Column:
        feature, th, value, gt, le = nodes[at]
        if feature < 0:
            return F.lit(float(value))
        return F.when(F.get(F.col(features), F.lit(feature)) > th, walk(nodes, gt)).otherwise(walk(nodes, le))

    total = F.lit(0.0)
    for nodes in by_tree.values():
        total = total + walk(nodes, 0)
    return samples.withColumn("score", total)


def best_stumps(samples: DataFrame, features: list[str], label: str = "y", weight: str = "w") -> DataFrame:
    """(feature, th, a, b, loss) of each feature's regression stump of the least weighted squared loss: a above th, b at or below. Prefix sums over the sorted distinct values; ties to the smaller th."""
    long = samples.select(F.col(label).alias("y"), F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("y", "w", "s.*")
    by_value = long.groupBy("feature", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"))
    up, whole = Window.partitionBy("feature").orderBy("x"), Window.partitionBy("feature")
    c = by_value.select("feature", "x", F.lead("x").over(up).alias("next"), F.sum("w").over(up).alias("w0"), F.sum("wy").over(up).alias("s0"), F.sum("w").over(whole).alias("wt"), F.sum("wy").over(whole).alias("st"), F.sum("wyy").over(whole).alias("qt"))
    c = c.filter("next is not null")
    w1, s1 = F.col("wt") - F.col("w0"), F.col("st") - F.col("s0")
    loss = F.round(F.col("qt") - F.col("s0") * F.col("s0") / F.col("w0") - s1 * s1 / w1, 9)
    rows = c.select("feature", ((F.col("x") + F.col("next")) / 2).alias("th"), (s1 / w1).alias("a"), (F.col("s0") / F.col("w0")).alias("b"), loss.alias("loss"))
    return rows.groupBy("feature").agg(F.min(F.struct("loss", "th", "a", "b")).alias("m")).select("feature", "m.th", "m.a", "m.b", "m.loss")


def gentle_boost(samples: DataFrame, features: list[str], rounds: int, label: str = "y") -> list[tuple]:
    """Gentle boosting with stumps on labels -1 and 1: a model as boosting_score reads it. Each round is one aggregate; only the best stump comes to the driver."""
    from tracelet.plans.durable import durable

    n = samples.select(*features, F.col(label).alias("y")).withColumn("w", F.lit(1.0)).withColumn("features", F.array(*[F.col(f).cast("double") for f in features]))
    model: list[tuple] = []
    for t in range(rounds):
        best = best_stumps(n, features).orderBy("loss", "feature").limit(1).collect()
        if not best:
            break
        s = best[0]
        model += [(t, 0, features.index(s["feature"]), s["th"], 0.0, 1, 2), (t, 1, -1, 0.0, s["a"], -1, -1), (t, 2, -1, 0.0, s["b"], -1, -1)]
        h = F.when(F.col(s["feature"]) > s["th"], s["a"]).otherwise(s["b"])
        n = n.withColumn("w", F.col("w") * F.exp(-F.col("y") * h))
        if t % 5 == 4:
            n = durable(n)
    return model


def _least_tree(samples: DataFrame, features: list[str], depth: int, tree: int) -> list[tuple]:
    """Rows of a regression tree (see boosting_score) of column y weighted by w, grown a level at a time: each level is one aggregate over all its nodes, and only a stump a node comes to the driver."""
    rows: list[tuple] = []
    where, open_, free = F.lit(0), {0: None}, 1
    for level in range(depth):
        at = samples.withColumn("node", where).filter(F.col("node").isin(list(open_)))
        long = at.select("node", "y", "w", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("node", "y", "w", "s.*")
        by_value = long.groupBy("node", "feature", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q"))
        up, whole = Window.partitionBy("node", "feature").orderBy("x"), Window.partitionBy("node", "feature")
        c = by_value.select("node", "feature", "x", F.lead("x").over(up).alias("next"), *[F.sum(k).over(up).alias(f"{k}0") for k in "ws"], *[F.sum(k).over(whole).alias(f"{k}t") for k in "wsq"]).filter("next is not null")
        w1, s1 = F.col("wt") - F.col("w0"), F.col("st") - F.col("s0")
        loss = F.round(F.col("qt") - F.col("s0") * F.col("s0") / F.col("w0") - s1 * s1 / w1, 9)
        best = c.groupBy("node").agg(F.min(F.struct(loss.alias("loss"), "feature", ((F.col("x") + F.col("next")) / 2).alias("th"), (s1 / w1).alias("a"), (F.col("s0") / F.col("w0")).alias("b"))).alias("m"))
        found = {r["node"]: r["m"] for r in best.collect()}
        below = {}
        for node in open_:
            if (m := found.get(node)) is None:
                rows.append((tree, node, -1, 0.0, open_[node] or 0.0, -1, -1))
                continue
            rows.append((tree, node, features.index(m["feature"]), m["th"], 0.0, free, free + 1))
            where = F.when(where == node, F.when(F.col(m["feature"]) > m["th"], free).otherwise(free + 1)).otherwise(where)
            below |= {free: m["a"], free + 1: m["b"]}
            free += 2
        open_ = below
        if not open_:
            break
    return rows + [(tree, node, -1, 0.0, value, -1, -1) for node, value in open_.items()]


def gradient_boost(samples: DataFrame, features: list[str], rounds: int, label: str = "y", depth: int = 1, rate: float = 0.5, loss: str = "l2", delta: float = 1.0) -> list[tuple]:
    """Gradient boosting of trees of a depth for the losses l2, l1 and huber: each round fits a tree to the loss' negative gradient; a model as boosting_score reads it."""
    from tracelet.plans.durable import durable

    n = samples.select(*features, F.col(label).cast("double").alias("target"), F.lit(0.0).alias("reached"), F.lit(1.0).alias("w")).withColumn("features", F.array(*[F.col(f).cast("double") for f in features]))
    model: list[tuple] = []
    for t in range(rounds):
        r = F.col("target") - F.col("reached")
        gradient = {"l2": r, "l1": F.signum(r), "huber": F.least(F.greatest(r, F.lit(-delta)), F.lit(delta))}[loss]
        tree = [(t, node, f, th, rate * value, gt, le) for _, node, f, th, value, gt, le in _least_tree(n.withColumn("y", gradient), features, depth, t)]
        model += tree
        n = boosting_score(n, tree).withColumn("reached", F.col("reached") + F.col("score")).drop("score")
        if t % 5 == 4:
            n = durable(n)
    return model


MODEL = "tree long, node long, feature long, th double, value double, gt long, le long"


def save_model(spark, model: list[tuple], path: str) -> None:
    """Rows of a model as JSON lines, in a folder of any store that Spark reaches."""
    spark.createDataFrame(model, MODEL).coalesce(1).write.json(path)


def load_model(spark, path: str) -> list[tuple]:
    names = [x.split()[0] for x in MODEL.split(", ")]
    return [tuple(r) for r in spark.read.schema(MODEL).json(path).select(*names).orderBy("tree", "node").collect()]


def precision_recall(scored: DataFrame, step: float = 0.3) -> DataFrame:
    """(threshold, precision, recall, accuracy, tp, fp, fn, tn) at thresholds a step apart from the least score to the most; rows (y, score), y > 0 is positive. One pass: scores fall into steps, and sums over the steps above do the rest."""
    limits = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    binned = scored.crossJoin(limits).select(F.floor((F.col("score") - F.col("lo")) / step).alias("b"), (F.col("y") > 0).cast("long").alias("p"))
    counts = binned.groupBy("b").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("n"))
    every = limits.select("lo", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step))).alias("b"))
    c = every.join(counts, "b", "left").na.fill(0, ["p", "n"])
    above, whole = Window.orderBy(F.desc("b")), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = c.select((F.col("lo") + F.col("b") * step).alias("threshold"), F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg"))
    s = s.withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp"))
    return s.select("threshold", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "pos").alias("recall"), ((F.col("tp") + F.col("tn")) / (F.col("pos") + F.col("neg"))).alias("accuracy"), "tp", "fp", "fn", "tn")


def platt(scored: DataFrame, iterations: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a score + b)) fitted to rows (y, score) by Newton's steps, targets smoothed by the class counts. Each step is one aggregate of five sums."""
    n = scored.agg(F.sum((F.col("y") > 0).cast("long")).alias("p"), F.count("*").alias("n")).collect()[0]
    pos, neg = n["p"] or 0, n["n"] - (n["p"] or 0)
    t = F.when(F.col("y") > 0, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    for _ in range(iterations):
        p = 1 / (1 + F.exp(a * F.col("score") + b))
        g, h = t - p, p * (1 - p)
        x = F.col("score")
        s = scored.agg(F.sum(x * g).alias("ga"), F.sum(g).alias("gb"), F.sum(x * x * h).alias("haa"), F.sum(x * h).alias("hab"), F.sum(h).alias("hbb")).collect()[0]
        hess = np.array([[s["haa"] + 1e-12, s["hab"]], [s["hab"], s["hbb"] + 1e-12]])
        da, db = np.linalg.solve(hess, [s["ga"], s["gb"]])
        a, b = a - float(da), b - float(db)
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def calibrated(scored: DataFrame, ab: tuple[float, float]) -> DataFrame:
    return scored.withColumn("probability", 1 / (1 + F.exp(ab[0] * F.col("score") + ab[1])))


def stratified_split(samples: DataFrame, share: float, label: str = "y", key: str = "id") -> DataFrame:
    """samples with held_out: in each class the given share, by hash of the key; the same rows each time."""
    order = F.percent_rank().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    return samples.withColumn("held_out", order < share)


def drop_incomplete(samples: DataFrame, features: str = "features") -> DataFrame:
    """Without samples that have a null or a NaN feature."""
    return samples.filter(~F.exists(features, lambda x: x.isNull() | F.isnan(x)))


def loss_l1(residual: Column) -> Column:
    return F.sum(F.abs(residual))


def loss_huber(residual: Column, delta: float) -> Column:
    """Quadratic up to delta, linear beyond, without the constant that would join the two."""
    r = F.abs(residual)
    return F.sum(F.when(r <= delta, 0.5 * r * r).otherwise(delta * r))


CELLS, RINGS = 24, 3


def ring_patterns(rings: int = RINGS) -> list[list[int]]:
    """Signs of the rings' cells in a pattern: each ring and each pair of rings against each other."""
    out = [[int(k == r) for k in range(rings)] for r in range(rings)]
    return out + [[(k == a) - (k == b) for k in range(rings)] for a, b in combinations(range(rings), 2)]


def combined_features(basic: DataFrame, cells: str = "cells", eccentricity: str = "eccentricity") -> DataFrame:
    """basic with features: the eccentricities, the cells, the ring patterns, all differences of two cells and of the sums of two disjoint pairs. cells has the same length in every row."""

    def differences(c: Column) -> Column:
        n = F.size(c)
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.get(c, i) - F.get(c, j))))
        return F.when(n > 1, pairs).otherwise(F.array().cast("array<double>"))

    c = F.col(cells)
    per = F.size(c) / RINGS
    ring = F.transform(F.sequence(F.lit(0), F.lit(RINGS - 1)), lambda r: F.aggregate(F.slice(c, (r * per + 1).cast("int"), per.cast("int")), F.lit(0.0), lambda s, x: s + x) / per)
    pattern = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in ring_patterns()])
    rings = F.transform(pattern, lambda p: F.aggregate(F.zip_with(p, F.col("__ring"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    two = F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(c, i) + F.get(c, i + 1))
    out = basic.withColumn("__ring", ring)
    return out.withColumn("features", F.concat(F.col(eccentricity), c, rings, differences(c), differences(two))).drop("__ring")


def healpix_nest(x: np.ndarray, y: np.ndarray, z: np.ndarray, nside: int) -> np.ndarray:
    """Pixel (nested numbering, nside a power of two) of directions: twelve base squares, whose two coordinates' bits are interleaved."""
    r = np.sqrt(x * x + y * y + z * z)
    c = z / r
    turn = np.mod(np.arctan2(y, x), 2 * np.pi) / (np.pi / 2)
    turn = np.where(turn >= 4, 0.0, turn)
    face, u, v = (np.zeros(len(c), np.int64) for _ in range(3))
    belt = np.abs(c) <= 2 / 3
    up, down = nside * (0.5 + turn - 0.75 * c), nside * (0.5 + turn + 0.75 * c)
    jp, jm = np.floor(up).astype(np.int64), np.floor(down).astype(np.int64)
    fp, fm = jp // nside, jm // nside
    belt_face = np.where(fp == fm, (fp & 3) + 4, np.where(fp < fm, fp & 3, (fm & 3) + 8))
    face[belt], u[belt], v[belt] = belt_face[belt], (jm % nside)[belt], (nside - 1 - jp % nside)[belt]
    caps = ~belt
    quarter = np.minimum(3, turn.astype(np.int64))
    part = turn - quarter
    t = nside * np.sqrt(3 * np.maximum(0, 1 - np.abs(c)))
    a = np.minimum(nside - 1, (part * t).astype(np.int64))
    b = np.minimum(nside - 1, ((1 - part) * t).astype(np.int64))
    north = c >= 0
    face[caps] = np.where(north, quarter, quarter + 8)[caps]
    u[caps] = np.where(north, nside - 1 - b, a)[caps]
    v[caps] = np.where(north, nside - 1 - a, b)[caps]
    code = np.zeros(len(c), np.int64)
    for bit in range(max(1, int(nside).bit_length() - 1)):
        code |= ((u >> bit) & 1) << (2 * bit) | ((v >> bit) & 1) << (2 * bit + 1)
    return face * nside * nside + code


def direction_cells(df: DataFrame, nside: int = 1) -> DataFrame:
    """df (x, y, z) with cell, the pixel of each direction."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(healpix_nest(x.to_numpy(float), y.to_numpy(float), z.to_numpy(float), nside))

    return df.withColumn("cell", run("x", "y", "z"))


def ellipsoid_cells(voxels: DataFrame, ellipsoids: DataFrame, nside: int = 1, rings: int = RINGS) -> DataFrame:
    """(id, ring, cell, mean, n): mean intensity by ring and direction cell around each ellipsoid (id, x, y, z, w), in the frame of its own axes, out to rings half-axes. voxels (id, x, y, z, v) are those near each ellipsoid."""
    from tracelet.operators.mixture import eigen3

    e = eigen3(ellipsoids).select("id", *[F.col(c).alias(f"m{c}") for c in AXES], "eigenvalues", "vectors")
    met = voxels.join(e, "id")
    d = [F.col(c) - F.col(f"m{c}") for c in AXES]
    local = [sum((F.get(F.col("vectors"), F.lit(3 * i + j)) * d[j] for j in range(3)), F.lit(0.0)) * F.sqrt(F.get(F.col("eigenvalues"), F.lit(i))) for i in range(3)]
    met = met.select("id", "v", *[p.alias(c) for p, c in zip(local, AXES)])
    radius = F.sqrt(sum((F.col(c) * F.col(c) for c in AXES), F.lit(0.0)))
    near = met.withColumn("ring", F.floor(radius).cast("int")).filter((F.col("ring") < rings) & (radius > 0))
    return direction_cells(near, nside).groupBy("id", "ring", "cell").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def normalised(boxes: DataFrame) -> DataFrame:
    """(id, v) rows with v less its mean, over its sample deviation; 1 for variances under 0.001."""
    w = Window.partitionBy("id")
    sd = F.when(F.var_samp("v").over(w) < 1e-3, 1.0).otherwise(F.stddev_samp("v").over(w))
    return boxes.withColumn("v", (F.col("v") - F.avg("v").over(w)) / sd)


def interpolated(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """(id, v): the value of a picture (x, y, z whole, v) at points (id, x, y, z) between its voxels, weighted by nearness along each axis; voxels that aren't there count as 0."""
    near = points
    weight = F.lit(1.0)
    for c in ("x", "y", "z"):
        low = F.floor(c)
        part = F.array(F.struct(low.alias("at"), (1 - (F.col(c) - low)).alias("w")), F.struct((low + 1).alias("at"), (F.col(c) - low).alias("w")))
        near = near.withColumn(f"c{c}", F.explode(part))
        weight = weight * F.col(f"c{c}.w")
    near = near.select("id", weight.alias("w"), *[F.col(f"c{c}.at").alias(c) for c in "xyz"])
    met = near.filter("w > 0").join(voxels.select("x", "y", "z", "v"), ["x", "y", "z"])
    return points.select("id").distinct().join(met.groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("v")), "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))


def ellipsoid_boxes(ellipsoids: DataFrame, voxels: DataFrame, boxes: int = 3, samples: int = 2, reach: float = 1.5) -> DataFrame:
    """(id, i, j, k, mean): mean interpolated intensity in boxes x boxes x boxes boxes around each ellipsoid (id, x, y, z, w: packed precision), along its own axes, from -reach to reach half-axes; samples points a box and axis. The longest axis comes first, each with its largest part positive."""
    from tracelet.operators.mixture import eigen3

    e = eigen3(ellipsoids)
    n = boxes * samples
    for a in ("p", "q", "r"):
        e = e.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    along = [reach * ((2.0 * F.col(a) + 1) / n - 1) / F.sqrt(F.col("eigenvalues")[i]) for i, a in enumerate("pqr")]
    place = [F.col(c) + sum((along[i] * F.col("vectors")[3 * i + j] for i in range(3)), F.lit(0.0)) for j, c in enumerate("xyz")]
    own = F.struct("id", "p", "q", "r")
    at = e.select(own.alias("id"), *[x.alias(c) for x, c in zip(place, "xyz")])
    box = [F.floor(F.col(f"id.{a}") / samples).cast("int").alias(to) for a, to in zip("pqr", "ijk")]
    return interpolated(at, voxels).select(F.col("id.id").alias("id"), *box, "v").groupBy("id", "i", "j", "k").agg(F.avg("v").alias("mean"))


def box_contrasts(boxes: DataFrame) -> DataFrame:
    """(id, axis, contrast) of three boxes an axis: the middle third's mean less that of the two outer ones, along each axis."""
    long = boxes.select("id", "mean", F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(a).alias("at")) for n, a in enumerate("ijk")])).alias("s"))
    middle, outer = F.avg(F.when(F.col("s.at") == 1, F.col("mean"))), F.avg(F.when(F.col("s.at") != 1, F.col("mean")))
    return long.groupBy("id", F.col("s.axis").alias("axis")).agg((middle - outer).alias("contrast"))


def mean_by_cell(voxels: DataFrame, nside: int = 1) -> DataFrame:
    """(id, cell, mean, n): mean intensity by direction cell of voxels (id, x, y, z: offset from the centre, v)."""
    return direction_cells(voxels, nside).groupBy("id", "cell").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
