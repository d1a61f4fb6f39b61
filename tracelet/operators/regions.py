"""Regions as sets of voxels: rows (sv_id, voxel_id), on demand with frame, x, y, z and v."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.functions.geometry import PAIRS, inverse

AXES = ("x", "y", "z")


def neighbour_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Offsets of 4, 8 (in the plane), 6, 26, 74 (a box of +-2 in the plane and +-1 across) and 75 neighbours (steps of 3 up to +-6 in the plane, 3 planes)."""
    r = range
    boxes = {
        4: [(x, y, 0) for x in r(-1, 2) for y in r(-1, 2) if abs(x) + abs(y) == 1],
        8: [(x, y, 0) for x in r(-1, 2) for y in r(-1, 2) if x or y],
        6: [(x, y, z) for x in r(-1, 2) for y in r(-1, 2) for z in r(-1, 2) if abs(x) + abs(y) + abs(z) == 1],
        26: [(x, y, z) for x in r(-1, 2) for y in r(-1, 2) for z in r(-1, 2) if x or y or z],
        74: [(x, y, z) for x in r(-2, 3) for y in r(-2, 3) for z in r(-1, 2) if x or y or z],
        75: [(x, y, z) for x in r(-6, 7, 3) for y in r(-6, 7, 3) for z in r(-1, 2) if x or y or z],
    }
    if connectivity not in boxes:
        raise ValueError(f"connectivity {connectivity} isn't one of {sorted(boxes)}")
    return sorted(boxes[connectivity])


def shifted(voxels: DataFrame, connectivity: int) -> DataFrame:
    """Each voxel (with x, y, z) moved by each offset: its columns with nx, ny, nz. Coordinates are compared, so nothing wraps around an edge."""
    offsets = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for d, c in zip(o, AXES)]) for o in neighbour_offsets(connectivity)])
    moved = voxels.withColumn("o", F.explode(offsets))
    return moved.select(*voxels.columns, *[(F.col(c) + F.col(f"o.d{c}")).alias(f"n{c}") for c in AXES])


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n_common, n_a, n_b, relative, jaccard) of regions with a voxel in common. Regions of a side may share voxels."""
    sizes = [d.groupBy(F.col("sv_id").alias(s)).agg(F.count("*").alias(f"n_{s}")) for d, s in ((a, "a"), (b, "b"))]
    left = a.select(F.col("sv_id").alias("a"), "voxel_id")
    right = b.select(F.col("sv_id").alias("b"), "voxel_id")
    met = left.join(right, "voxel_id").groupBy("a", "b").agg(F.count("*").alias("n_common"))
    n = F.col("n_common")
    return met.join(sizes[0], "a").join(sizes[1], "b").select(
        "a", "b", "n_common", "n_a", "n_b", (n / F.col("n_a")).alias("relative"), (n / (F.col("n_a") + F.col("n_b") - n)).alias("jaccard")
    )


def overlap_shifted(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard index of pairs (a, b) after a's voxels are moved by the truncated difference of the centroids; 0 for no overlap."""

    def centre(d: DataFrame, s: str) -> DataFrame:
        return d.groupBy(F.col("sv_id").alias(s)).agg(*[F.avg(c).alias(f"{s}_{c}") for c in AXES], F.count("*").alias(f"n_{s}"))

    p = pairs.select("a", "b").join(centre(a, "a"), "a").join(centre(b, "b"), "b")
    p = p.select("a", "b", "n_a", "n_b", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).cast("int").alias(f"d{c}") for c in AXES])
    moved = p.join(a.select(F.col("sv_id").alias("a"), *AXES), "a").select("a", "b", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in AXES])
    common = moved.join(b.select(F.col("sv_id").alias("b"), *AXES), ["b", *AXES]).groupBy("a", "b").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return p.join(common, ["a", "b"], "left").select("a", "b", (n / (F.col("n_a") + F.col("n_b") - n)).alias("jaccard"))


def touching(a: DataFrame, b: DataFrame, connectivity: int) -> DataFrame:
    """(a, b, n_border, n_border_b) of regions that touch: distinct voxels on either side with a neighbour on the other. Rows have sv_id, x, y, z."""
    left = shifted(a.select(F.col("sv_id").alias("a"), *AXES), connectivity)
    right = b.select(F.col("sv_id").alias("b"), *[F.col(c).alias(f"n{c}") for c in AXES])
    met = left.join(right, [f"n{c}" for c in AXES]).filter("a <> b")
    return met.groupBy("a", "b").agg(F.count_distinct(F.struct(*AXES)).alias("n_border"), F.count_distinct(F.struct(*[f"n{c}" for c in AXES])).alias("n_border_b"))


def compactness(voxels: DataFrame, connectivity: int) -> DataFrame:
    """(sv_id, n, mean_neighbours): mean number of neighbours of a voxel that belong to its own region."""
    moved = shifted(voxels.select("sv_id", *AXES), connectivity)
    own = voxels.select("sv_id", *[F.col(c).alias(f"n{c}") for c in AXES])
    inside = moved.join(own, ["sv_id", *[f"n{c}" for c in AXES]]).groupBy("sv_id").agg(F.count("*").alias("k"))
    return voxels.groupBy("sv_id").agg(F.count("*").alias("n")).join(inside, "sv_id", "left").select("sv_id", "n", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("mean_neighbours"))


def border_voxels(voxels: DataFrame, connectivity: int) -> DataFrame:
    """Contour: the voxels of a region with a neighbour outside it."""
    k = len(neighbour_offsets(connectivity))
    moved = shifted(voxels.select("sv_id", *AXES), connectivity)
    own = voxels.select("sv_id", *[F.col(c).alias(f"n{c}") for c in AXES])
    full = moved.join(own, ["sv_id", *[f"n{c}" for c in AXES]]).groupBy("sv_id", *AXES).agg(F.count("*").alias("k")).filter(F.col("k") == k)
    return voxels.join(full, ["sv_id", *AXES], "left_anti")


def merge_regions(voxels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Voxels of regions put together under mapping (sv_id, into); copies of a voxel stay, as in a union of lists."""
    return voxels.join(mapping, "sv_id", "left").withColumn("sv_id", F.coalesce("into", "sv_id")).drop("into")


def merged_centroids(centroids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Size-weighted centroids of merged regions; centroids (sv_id, n, x, y, z)."""
    into = centroids.join(mapping, "sv_id", "left").withColumn("sv_id", F.coalesce("into", "sv_id"))
    return into.groupBy("sv_id").agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in AXES])


def weighted_centroid(voxels: DataFrame, *keys: str) -> DataFrame:
    """Sum of v and v-weighted mean of x, y, z by key; null where the weights vanish."""
    v = F.col("v")
    return voxels.groupBy(*keys).agg(F.sum(v).alias("weight"), *[F.try_divide(F.sum(v * F.col(c)), F.sum(v)).alias(c) for c in AXES])


EMPTY_WEIGHT = 1e-5


def weighted_moments(voxels: DataFrame, *keys: str) -> DataFrame:
    """weight, mean x, y, z and packed covariance of v-weighted positions; below EMPTY_WEIGHT mean 0 and the identity. Positions are taken from the key's least, which keeps the raw moments small."""
    v = F.col("v")
    raw = voxels.groupBy(*keys).agg(
        F.sum(v).alias("weight"),
        *[F.sum(v * F.col(c)).alias(f"s{c}") for c in AXES],
        *[F.sum(v * F.col(AXES[i]) * F.col(AXES[j])).alias(f"s{i}{j}") for i, j in PAIRS],
    )
    w, empty = F.col("weight"), F.col("weight") < EMPTY_WEIGHT
    mean = {c: F.when(empty, 0.0).otherwise(F.try_divide(F.col(f"s{c}"), w)) for c in AXES}
    cov = [F.when(empty, float(i == j)).otherwise(F.try_divide(F.col(f"s{i}{j}"), w) - mean[AXES[i]] * mean[AXES[j]]) for i, j in PAIRS]
    return raw.select(*keys, "weight", *[mean[c].alias(c) for c in AXES], F.array(*cov).alias("covariance"))


def precision(moments: DataFrame) -> DataFrame:
    """Adds the packed precision w; null for a flat region, which regularise() settles."""
    return moments.withColumn("w", inverse(F.col("covariance")))


def num_holes(voxels: DataFrame, dx: int) -> DataFrame:
    """(sv_id, n_holes): sum of the gaps in the sorted indices that are shorter than a third of a row."""
    gap = F.col("voxel_id") - F.lag("voxel_id").over(Window.partitionBy("sv_id").orderBy("voxel_id")) - 1
    g = voxels.select("sv_id", gap.alias("gap"))
    return g.groupBy("sv_id").agg(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") * 3 < dx), F.col("gap")).otherwise(0)).alias("n_holes"))


def is_sorted(region: Column) -> Column:
    """Whether a list of voxels strictly increases; true for the empty list."""
    return F.forall(F.sequence(F.lit(2), F.greatest(F.size(region), F.lit(1))), lambda i: (F.size(region) < 2) | (i > F.size(region)) | (F.get(region, i - 2) < F.get(region, i - 1)))


def delta_z(voxels: DataFrame) -> DataFrame:
    """(sv_id, delta_z): z at 95 % of the sorted voxels less z at 5 %."""
    z = F.sort_array(F.collect_list("z"))
    at = lambda p: F.get(F.col("zs"), F.floor(F.size("zs") * F.lit(p)).cast("int"))
    return voxels.groupBy("sv_id").agg(z.alias("zs")).select("sv_id", (at(0.95) - at(0.05)).alias("delta_z"))


def best_candidate(overlaps: DataFrame, by: str = "n_common") -> DataFrame:
    """Each b's best a, ties to the smaller: (b, a, score)."""
    best = overlaps.groupBy("b").agg(F.max(F.struct(F.col(by).alias("score"), (-F.col("a")).alias("m"))).alias("t"))
    return best.select("b", (-F.col("t.m")).alias("a"), "t.score")


def mutual_best(overlaps: DataFrame, by: str = "n_common") -> DataFrame:
    """Pairs that are each other's best: (a, b, score)."""
    forth = best_candidate(overlaps, by)
    back = best_candidate(overlaps.select(F.col("b").alias("a"), F.col("a").alias("b"), by), by).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return forth.join(back, ["a", "b"]).select("a", "b", "score")


def one_to_many(overlaps: DataFrame, threshold: float, most: int, by: str = "relative") -> DataFrame:
    """Each b goes to its best a above the threshold; an a keeps its best `most`: (a, b, score, rank)."""
    best = best_candidate(overlaps.filter(F.col(by) > threshold), by)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("a", "b", "score", "rank")


def otsu(values: DataFrame, *keys: str, bins: int = 256) -> DataFrame:
    """Otsu's threshold of column v by key: the least bin that maximises the variance between classes, as a value; null for constant v.

    A value's bin is the whole part of (v - least) * (bins - 1) / (most - least).
    """
    limits = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    binned = values.join(limits.filter("hi > lo"), list(keys)).select(*keys, "lo", "hi", F.floor((F.col("v") - F.col("lo")) * (bins - 1) / (F.col("hi") - F.col("lo"))).alias("t"))
    counts = binned.groupBy(*keys, "lo", "hi", "t").agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    sums = counts.select("*", F.sum("n").over(up).alias("nb"), F.sum(F.col("n") * F.col("t")).over(up).alias("sb"), F.sum("n").over(whole).alias("na"), F.sum(F.col("n") * F.col("t")).over(whole).alias("sa")).filter("nb < na")
    gap = F.col("sb") / F.col("nb") - (F.col("sa") - F.col("sb")) / (F.col("na") - F.col("nb"))
    between = F.round(F.col("nb") * (F.col("na") - F.col("nb")) * gap * gap, 6)
    best = sums.groupBy(*keys).agg(F.max(F.struct(between.alias("s"), (-F.col("t")).alias("t"), "lo", "hi")).alias("m"))
    found = best.select(*keys, (-F.col("m.t") * (F.col("m.hi") - F.col("m.lo")) / (bins - 1) + F.col("m.lo")).alias("threshold"))
    return limits.select(*keys).join(found, list(keys), "left")


def region_threshold(values: DataFrame, max_size: int, share: float, background_subtracted: bool = False) -> DataFrame:
    """(sv_id, threshold): the largest of the max_size-th largest value, the value at (1 - share) of the ascending ones, and Otsu's; the first alone if the background is already subtracted."""
    a = values.groupBy("sv_id").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    n = F.size("vs")
    nth = F.get(F.col("vs"), F.greatest(n - max_size, F.lit(0)))
    if background_subtracted:
        return a.select("sv_id", nth.cast("double").alias("threshold"))
    at = F.get(F.col("vs"), F.least(F.floor(n * F.lit(1 - share)).cast("int"), n - 1))
    cut = otsu(values.select("sv_id", "v"), "sv_id").withColumnRenamed("threshold", "otsu")
    return a.join(cut, "sv_id", "left").select("sv_id", F.greatest(nth.cast("double"), at.cast("double"), "otsu").alias("threshold"))


def trim(voxels: DataFrame, thresholds: DataFrame, connectivity: int) -> DataFrame:
    """The voxels of each region reached from its first brightest one through voxels strictly above its threshold."""
    offsets = neighbour_offsets(connectivity)
    columns = ["sv_id", "voxel_id", *AXES, "v"]

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("voxel_id", kind="stable")
        place = {p: i for i, p in enumerate(zip(pdf.x, pdf.y, pdf.z))}
        above = (pdf.v > pdf.threshold.fillna(-np.inf)).to_numpy()
        seed = int(pdf.v.to_numpy().argmax())
        seen, todo = {seed}, [seed]
        at = list(place)
        while todo:
            x, y, z = at[todo.pop()]
            for dx, dy, dz in offsets:
                i = place.get((x + dx, y + dy, z + dz))
                if i is not None and i not in seen and above[i]:
                    seen.add(i)
                    todo.append(i)
        return pdf.iloc[sorted(seen)][columns]

    schema = ", ".join(f"{c} {dict(voxels.dtypes)[c]}" for c in columns)
    return voxels.select(*columns).join(thresholds, "sv_id").groupBy("sv_id").applyInPandas(flood, schema)


def remove_zeros(voxels: DataFrame) -> DataFrame:
    return voxels.filter(F.col("v") > 0)


def regions_of_labels(labels: DataFrame) -> DataFrame:
    """Label image (voxel_id, label) to regions (sv_id, voxels array): one for each label up to the largest, gaps empty, label 0 left out."""
    found = labels.filter("label > 0").groupBy(F.col("label").alias("sv_id")).agg(F.sort_array(F.collect_list("voxel_id")).alias("voxels"))
    every = labels.agg(F.max("label").alias("m")).filter("m > 0").select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("sv_id"))
    return every.join(found, "sv_id", "left").select("sv_id", F.coalesce("voxels", F.array().cast("array<bigint>")).alias("voxels"))
