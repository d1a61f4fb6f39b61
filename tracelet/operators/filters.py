"""Filters along lines, histograms and thresholds, grid arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.operators.regions import otsu  # noqa: F401  the same threshold, by key


def sliding(values: DataFrame, line: Sequence[str], along: str, radius: int) -> DataFrame:
    """values with mean, total, squares, least, most and var of v over the places within the radius on its line."""
    near = Window.partitionBy(*line).orderBy(along).rangeBetween(-radius, radius)
    v = F.col("v")
    return values.select("*", F.avg(v).over(near).alias("mean"), F.sum(v).over(near).alias("total"), F.sum(v * v).over(near).alias("squares"), F.min(v).over(near).alias("least"), F.max(v).over(near).alias("most"), F.var_pop(v).over(near).alias("var"))


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def box_kernel(radius: int) -> list[float]:
    return [1 / (2 * radius + 1)] * (2 * radius + 1)


def log_kernel(sigma: float, radius: int) -> list[float]:
    """Laplacian of a Gaussian, with zero sum."""
    w = [((i / sigma) ** 2 - 1) / sigma**2 * math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x - sum(w) / len(w) for x in w]


def dog_kernel(narrow: float, wide: float, radius: int) -> list[float]:
    return [a - b for a, b in zip(gaussian_kernel(narrow, radius), gaussian_kernel(wide, radius))]


def gabor_kernel(sigma: float, wave: float, radius: int) -> list[float]:
    return [math.exp(-0.5 * (i / sigma) ** 2) * math.cos(2 * math.pi * i / wave) for i in range(-radius, radius + 1)]


def convolve(values: DataFrame, line: Sequence[str], along: str, kernel: Sequence[float], name: str = "convolved") -> DataFrame:
    """values with the correlation of v with a kernel centred at each place of its line; places that aren't there count as 0. Places are whole numbers, each once."""
    r = len(kernel) // 2
    near = Window.partitionBy(*line).orderBy(along).rangeBetween(-r, r)
    got = F.collect_list(F.struct(F.col(along).alias("p"), F.col("v").alias("v"))).over(near)
    weights = F.array(*[F.lit(float(w)) for w in kernel])
    total = F.aggregate("got", F.lit(0.0), lambda s, x: s + F.get(weights, (x["p"] - F.col(along) + r).cast("int")) * x["v"])
    return values.withColumn("got", got).withColumn(name, total).drop("got")


def derivative(values: DataFrame, line: Sequence[str], along: str) -> DataFrame:
    """values with first and second central differences; null at the ends."""
    way = Window.partitionBy(*line).orderBy(along)
    before, after = F.lag("v").over(way), F.lead("v").over(way)
    return values.select("*", ((after - before) / 2.0).alias("d1"), (after - 2 * F.col("v") + before).alias("d2"))


def gradient(values: DataFrame, axes: Sequence[str] = ("x", "y", "z"), line: Sequence[str] = ()) -> DataFrame:
    """values with g_ and h_ by axis, first and second central differences, their laplacian and the gradient's size; null where a neighbour is missing. Places are whole numbers, each once."""
    out = values
    for c in axes:
        w = Window.partitionBy(*line, *[a for a in axes if a != c]).orderBy(c)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        whole = (F.lag(c).over(w) == F.col(c) - 1) & (F.lead(c).over(w) == F.col(c) + 1)
        out = out.withColumn(f"g_{c}", F.when(whole, (after - before) / 2.0)).withColumn(f"h_{c}", F.when(whole, after + before - 2.0 * F.col("v")))
    total = lambda terms: reduce(lambda p, q: p + q, terms)
    return out.withColumn("laplacian", total([F.col(f"h_{c}") for c in axes])).withColumn("steepness", F.sqrt(total([F.col(f"g_{c}") * F.col(f"g_{c}") for c in axes])))


def median2d(values: DataFrame, radius: int, plane: Sequence[str] = ("slice",), tile: int = 64) -> DataFrame:
    """(plane, x, y, median) over the square of the radius; places outside the picture count as 0, and the median is the middle of all of them. A place is dealt to its tile, and to those that it borders; a tile is one array."""
    side = 2 * radius + 1
    kinds = dict(values.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.tx.iloc[0]) * tile, int(pdf.ty.iloc[0]) * tile
        x, y = pdf.x.to_numpy() - x0, pdf.y.to_numpy() - y0
        area = np.zeros((tile + 2 * radius, tile + 2 * radius), pdf.v.dtype)
        area[x + radius, y + radius] = pdf.v.to_numpy()
        inside = (x >= 0) & (x < tile) & (y >= 0) & (y < tile)
        around = np.lib.stride_tricks.sliding_window_view(area, (side, side))[x[inside], y[inside]].reshape(-1, side * side)
        out = pdf.loc[inside, [*plane, "x", "y"]].copy()
        out["median"] = np.partition(around, side * side // 2, 1)[:, side * side // 2]
        return out

    dealt = values.select(*plane, "x", "y", "v")
    for c in ("x", "y"):
        lo, hi = (F.floor((F.col(c) + r) / tile) for r in (-radius, radius))
        dealt = dealt.withColumn(f"t{c}", F.explode(F.sequence(lo, hi)))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*plane, "x", "y"]] + [f"median {kinds['v']}"])
    return dealt.groupBy(*plane, "tx", "ty").applyInPandas(run, schema)


def histogram(values: DataFrame, size: float, offset: float, *keys: str) -> DataFrame:
    """(keys, bin, n)."""
    return values.groupBy(*keys, F.floor((F.col("v") - offset) / size).alias("bin")).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, *keys: str) -> DataFrame:
    """In bits, by key."""
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def cross_entropy(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cross_entropy and relative_entropy of histogram a (bin, n) under b, in bits, over bins that both have."""
    pa = a.crossJoin(a.agg(F.sum("n").alias("t"))).select("bin", (F.col("n") / F.col("t")).alias("p"))
    pb = b.crossJoin(b.agg(F.sum("n").alias("t"))).select("bin", (F.col("n") / F.col("t")).alias("q"))
    return pa.join(pb, "bin").agg((-F.sum(F.col("p") * F.log2("q"))).alias("cross_entropy"), F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("relative_entropy"))


def percentile_value(hist: DataFrame, share: float, *keys: str) -> DataFrame:
    """(keys, bin): the least bin at or below which at least the share lies."""
    up = hist.select(*keys, "bin", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")).alias("c"), F.sum("n").over(Window.partitionBy(*keys)).alias("t"))
    return up.filter(F.col("c") >= share * F.col("t")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def triangle_threshold(hist: DataFrame, *keys: str) -> DataFrame:
    """(keys, threshold): one more than the bin right of the peak that lies farthest below the line from the peak to the last bin; heights of the line are whole numbers. The peak and ties go to the lowest bin; hist holds bins with n > 0."""
    h = hist.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("p"), F.max("bin").alias("last")).select(*keys, F.col("p.n").alias("top"), (-F.col("p.m")).alias("peak"), "last")
    tail = hist.groupBy(*keys).agg(F.max_by("n", "bin").alias("end"))
    every = h.join(tail, list(keys)).filter("last > peak").withColumn("bin", F.explode(F.sequence("peak", "last")))
    at = every.join(hist.select(*keys, "bin", "n"), [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    line = F.col("top") + ((F.col("end") - F.col("top")) * (F.col("bin") - F.col("peak")) / (F.col("last") - F.col("peak")))
    gap = F.floor(line) - F.col("n")
    best = at.groupBy(*keys).agg(F.max(F.struct(gap.alias("g"), (-F.col("bin")).alias("m"))).alias("b"))
    return best.select(*keys, (1 - F.col("b.m")).alias("threshold"))


def intermeans_threshold(hist: DataFrame, *keys: str) -> DataFrame:
    """(keys, threshold): from the middle of the range, the whole mean of the two sides' means, until it stays; a histogram is one row set of a key."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, n = pdf.bin.to_numpy(float), pdf.n.to_numpy(float)
        t, seen = math.floor((bins.min() + bins.max()) / 2), set()
        while t not in seen:
            seen.add(t)
            low = bins <= t
            if low.all() or not low.any():
                break
            t = math.floor(((bins[low] * n[low]).sum() / n[low].sum() + (bins[~low] * n[~low]).sum() / n[~low].sum()) / 2)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "threshold": [int(t)]})

    schema = ", ".join([f"{k} {dict(hist.dtypes)[k]}" for k in keys] + ["threshold long"])
    return hist.groupBy(*keys).applyInPandas(settle, schema)


def rescale(values: DataFrame, low: float, high: float, *keys: str) -> DataFrame:
    """values with scaled: v mapped so that the key's least is low and its most is high; low where v is constant."""
    limits = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = values.join(limits, list(keys)) if keys else values.crossJoin(limits)
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return joined.withColumn("scaled", low + share * (high - low)).drop("lo", "hi")


OPERATIONS = ("set", "add", "sub", "mul", "div", "pow", "lsh", "rsh", "min", "max")


def combine(a: Column, operation: str, b: Column) -> Column:
    """Elementwise array operation."""
    made = {
        "set": lambda: b,
        "add": lambda: a + b,
        "sub": lambda: a - b,
        "mul": lambda: a * b,
        "div": lambda: a / b,
        "pow": lambda: F.pow(a, b),
        "lsh": lambda: F.call_function("shiftleft", a, b.cast("int")),
        "rsh": lambda: F.call_function("shiftright", a, b.cast("int")),
        "min": lambda: F.least(a, b),
        "max": lambda: F.greatest(a, b),
    }
    return made[operation]()


def transposed(values: DataFrame) -> DataFrame:
    """x and y of each place exchanged."""
    return values.withColumnsRenamed({"x": "x2", "y": "x"}).withColumnRenamed("x2", "y")


RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "int32": (-(1 << 31), (1 << 31) - 1), "float": None}


def converted(values: DataFrame, kind: str, shift: int = 0) -> DataFrame:
    """v as a kind of RANGES, after a shift of its bits to the left (to the right if negative); whole kinds are kept to their range."""
    c = F.col("v")
    if shift:
        c = F.call_function("shiftleft" if shift > 0 else "shiftright", c.cast("long"), F.lit(abs(shift)))
    limits = RANGES[kind]
    return values.withColumn("v", c.cast("double") if limits is None else F.least(F.greatest(c, F.lit(limits[0])), F.lit(limits[1])).cast("long"))


def applied(values: DataFrame, rule: Column) -> DataFrame:
    """v by a rule of the value and its coordinates."""
    return values.withColumn("v", rule)


def stacked(pictures: list[DataFrame], name: str = "layer") -> DataFrame:
    """Pictures of the same columns as one, numbered from 0."""
    return reduce(DataFrame.unionByName, [p.withColumn(name, F.lit(i)) for i, p in enumerate(pictures)])


def threshold(values: DataFrame, cut: float) -> DataFrame:
    return values.withColumn("on", (F.col("v") >= cut).cast("int"))


def clip(values: DataFrame, low: Sequence[int], high: Sequence[int], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """A box, its upper corner included."""
    for c, a, b in zip(axes, low, high):
        values = values.filter(F.col(c).between(a, b))
    return values


def pad(values: DataFrame, low: Sequence[int], high: Sequence[int], axes: Sequence[str] = ("x", "y", "z"), fill: float = 0) -> DataFrame:
    """Every place of the box, with fill where values has none."""
    grid = values.sparkSession.range(1).drop("id")
    for c, a, b in zip(axes, low, high):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(a), F.lit(b))))
    return grid.join(values, list(axes), "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def down_sample(values: DataFrame, box: int, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Means of boxes."""
    return values.groupBy(*[F.floor(F.col(c) / box).alias(c) for c in axes]).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def apply_map(values: DataFrame, table: DataFrame) -> DataFrame:
    """v through a lookup table (v, to); null where it has none."""
    return values.join(table, "v", "left").drop("v").withColumnRenamed("to", "v")


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outer product of two vectors (i, v): (i, j, v)."""
    return a.select("i", F.col("v").alias("p")).crossJoin(b.select(F.col("i").alias("j"), F.col("v").alias("q"))).select("i", "j", (F.col("p") * F.col("q")).alias("v"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of sparse matrices (i, j, v)."""
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("q"))
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("p")).join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def spectrum(lines: DataFrame, line: Sequence[str], along: str, invert: bool = False) -> DataFrame:
    """Discrete Fourier transform of v along each line: (line, k, re, im). Padded with zeros to a power of two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(along).v.to_numpy(float)
        n = 1 << max(0, (len(v) - 1).bit_length())
        f = np.fft.ifft(v, n) if invert else np.fft.fft(v, n)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * n for c in line}, "k": np.arange(n), "re": f.real, "im": f.imag})

    schema = ", ".join([f"{c} {dict(lines.dtypes)[c]}" for c in line] + ["k long", "re double", "im double"])
    return lines.groupBy(*line).applyInPandas(run, schema)


def distance_to_background(grid: DataFrame, most: int) -> DataFrame:
    """(x, y, z, d2): squared distance of each place with v > 0 to the nearest with v = 0; null beyond `most`."""
    from tracelet.operators.spatial import knn_join

    ids = grid.withColumn("id", F.xxhash64("x", "y", "z")).withColumn("frame", F.lit(0))
    near = knn_join(ids.filter("v > 0"), ids.filter("v = 0"), 1, most + 0.5)
    return ids.filter("v > 0").join(near.select(F.col("a_id").alias("id"), "d2"), "id", "left").select("x", "y", "z", "d2")
