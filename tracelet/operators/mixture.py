"""Gaussian mixtures over regions: E and M steps, priors, splits, scores, motion.

Components are rows (frame, k, alpha, beta, nu, m array(3), w packed(6)) with
priors alpha0, beta0, nu0, m0, w0. A region is its voxels (frame, sv_id, x, y,
z, v). One step is a plan of joins and aggregates; the whole fit runs frame by
frame, each frame in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.functions.geometry import PAIRS, determinant, inverse, quadratic_form

AXES = ("x", "y", "z")
DEAD_SHARE = 1e-5
FLAT = 1e-8


def digamma(x: Column) -> Column:
    """For x > 0, to about 1e-12: stepped up to 8 or more, then the asymptotic series."""
    shift = F.when(x < 8, 8.0).otherwise(0.0)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + 1.0 / (x + i))
    y = x + shift
    z = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132)))))
    return F.when(x < 8, series - steps).otherwise(series)


def np_digamma(x):
    x = np.asarray(x, float)
    steps = sum(np.where(x < 8, 1.0 / (x + i), 0.0) for i in range(8))
    y = np.where(x < 8, x + 8.0, x)
    z = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps


def with_expectations(gmm: DataFrame) -> DataFrame:
    """gmm with e_log_pi and e_log_det."""
    total = F.sum("alpha").over(Window.partitionBy("frame"))
    nu = F.col("nu")
    halves = digamma(nu / 2.0) + digamma((nu - 1.0) / 2.0) + digamma((nu - 2.0) / 2.0)
    return gmm.withColumn("e_log_pi", digamma(F.col("alpha")) - digamma(total)).withColumn("e_log_det", halves + 3 * float(np.log(2)) + F.log(determinant(F.col("w"))))


def e_step(voxels: DataFrame, gmm: DataFrame, candidates: DataFrame) -> DataFrame:
    """(frame, sv_id, k, s, r): log responsibilities, not weighted by intensity, summed over a region's voxels for its candidate components (frame, sv_id, k), and their soft-max."""
    g = with_expectations(gmm).select("frame", "k", "beta", "nu", "m", "w", "e_log_pi", "e_log_det")
    met = candidates.join(g, ["frame", "k"]).join(voxels, ["frame", "sv_id"])
    d = quadratic_form([F.col(c) - F.col("m")[i] for i, c in enumerate(AXES)], F.col("w"))
    term = F.col("e_log_pi") + 0.5 * F.col("e_log_det") - 0.5 * (3.0 / F.col("beta") + F.col("nu") * d)
    s = met.groupBy("frame", "sv_id", "k").agg(F.sum(term).alias("s"))
    own = Window.partitionBy("frame", "sv_id")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(own)))
    return e.select("frame", "sv_id", "k", "s", (F.col("e") / F.sum("e").over(own)).alias("r"))


def region_moments(voxels: DataFrame) -> DataFrame:
    """(frame, sv_id, n, sx.., s00..): v-weighted raw moments of a region, made once and reused by every M step."""
    v = F.col("v")
    return voxels.groupBy("frame", "sv_id").agg(
        F.sum(v).alias("n"), *[F.sum(v * F.col(c)).alias(f"s{c}") for c in AXES], *[F.sum(v * F.col(AXES[i]) * F.col(AXES[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    )


def m_step(moments: DataFrame, resp: DataFrame, gmm: DataFrame) -> DataFrame:
    """gmm with its posteriors (alpha, beta, nu, m, w) from region moments weighted by r, and n_k. w isn't yet regularised."""
    names = ["n", *[f"s{c}" for c in AXES], *[f"s{i}{j}" for i, j in PAIRS]]
    sums = resp.join(moments, ["frame", "sv_id"]).groupBy("frame", "k").agg(*[F.sum(F.col("r") * F.col(c)).alias(c) for c in names])
    g = gmm.join(sums, ["frame", "k"], "left").na.fill(0.0, names)
    n, b0 = F.col("n"), F.col("beta0")
    mean = [F.coalesce(F.try_divide(F.col(f"s{c}"), n), F.lit(0.0)) for c in AXES]
    gap = [mean[i] - F.col("m0")[i] for i in range(3)]
    inv0 = inverse(F.col("w0"))
    spread = [F.col(f"s{i}{j}") - n * mean[i] * mean[j] for i, j in PAIRS]
    w_inv = F.array(*[inv0[q] + spread[q] + b0 * n / (b0 + n) * gap[i] * gap[j] for q, (i, j) in enumerate(PAIRS)])
    out = g.withColumn("w_inv", w_inv)
    m = F.array(*[(b0 * F.col("m0")[i] + F.col(f"s{c}")) / (b0 + n) for i, c in enumerate(AXES)])
    return out.select(
        "frame", "k", n.alias("n_k"), F.greatest(F.col("alpha0") + n, F.lit(0.0)).alias("alpha"), (b0 + n).alias("beta"), (F.col("nu0") + n).alias("nu"), m.alias("m"), inverse(F.col("w_inv")).alias("w"), "alpha0", "beta0", "nu0", "m0", "w0"
    )


def log_likelihood(voxels: DataFrame, gmm: DataFrame, candidates: DataFrame) -> DataFrame:
    """(frame, ll): sum of v log sum_k pi_k N(x | m_k, (nu_k W_k)^-1) over the candidates of each voxel's region."""
    total = F.sum("alpha").over(Window.partitionBy("frame"))
    g = gmm.select("frame", "k", "nu", "m", "w", (F.col("alpha") / total).alias("pi"))
    met = candidates.join(g, ["frame", "k"]).join(voxels, ["frame", "sv_id"])
    d = quadratic_form([F.col(c) - F.col("m")[i] for i, c in enumerate(AXES)], F.col("w")) * F.col("nu")
    density = F.col("pi") * F.sqrt(determinant(F.col("w")) * F.pow("nu", F.lit(3))) * float((2 * np.pi) ** -1.5) * F.exp(-0.5 * d)
    each = met.groupBy("frame", "sv_id", *AXES).agg(F.first("v").alias("v"), F.sum(density).alias("p"))
    return each.groupBy("frame").agg(F.sum(F.col("v") * F.log("p")).alias("ll"))


def kill_dead(gmm: DataFrame) -> DataFrame:
    """Components with less than DEAD_SHARE of alpha, or without a precision, lose it: alpha 0, m null."""
    share = F.col("alpha") / F.sum("alpha").over(Window.partitionBy("frame"))
    dead = (share < DEAD_SHARE) | F.col("w").isNull() | F.exists("w", lambda x: F.isnan(x) | x.isNull())
    return gmm.withColumn("dead", dead).withColumn("alpha", F.when(F.col("dead"), 0.0).otherwise(F.col("alpha"))).withColumn("m", F.when(~F.col("dead"), F.col("m"))).drop("dead")


def hard_links(resp: DataFrame, least: float = 0.5) -> DataFrame:
    """(frame, sv_id, k) where a component holds more than the least share of a region. None is dropped for being one of many."""
    return resp.filter(F.col("r") > least).select("frame", "sv_id", "k")


def strongest(resp: DataFrame, least: float = 0.3) -> DataFrame:
    """(frame, sv_id, k): the component of the largest share, ties to the smaller; null unless it is over the least."""
    best = resp.groupBy("frame", "sv_id").agg(F.max(F.struct("r", (-F.col("k")).alias("m"))).alias("b"))
    return best.select("frame", "sv_id", F.when(F.col("b.r") > least, -F.col("b.m")).alias("k"))


def divergence(voxels: DataFrame, resp: DataFrame, gmm: DataFrame) -> DataFrame:
    """(frame, k, split_score): how far each component's share of intensity is from its Gaussian (local Kullback-Leibler divergence)."""
    g = gmm.select("frame", "k", "nu", "m", "w")
    met = resp.filter(F.col("r") > 1e-3).join(g, ["frame", "k"]).join(voxels, ["frame", "sv_id"])
    q = F.col("r") * F.col("v")
    d = quadratic_form([F.col(c) - F.col("m")[i] for i, c in enumerate(AXES)], F.col("w")) * F.col("nu")
    log_pdf = 0.5 * F.log(determinant(F.col("w")) * F.pow("nu", F.lit(3))) - float(1.5 * np.log(2 * np.pi)) - 0.5 * d
    return met.filter(q > 0).groupBy("frame", "k").agg((F.sum(q * (F.log(q) - log_pdf)) / F.sum(q) - F.log(F.sum(q))).alias("split_score"))


def update_priors(gmm: DataFrame, alpha_share: float, beta_share: float, nu_share: float) -> DataFrame:
    """The posteriors become priors of the next frame: m0 = m, beta0 = max(share n, 1e-5), nu0 = max(share n, 3), w0 = w nu / nu0, alpha0 = share of a hundred-thousandth of all alpha."""
    total = F.sum("alpha").over(Window.partitionBy("frame"))
    nu0 = F.greatest(nu_share * F.col("n_k"), F.lit(3.0))
    return gmm.withColumn("alpha0", total * 1e-5 * alpha_share).withColumn("m0", F.col("m")).withColumn("beta0", F.greatest(beta_share * F.col("n_k"), F.lit(1e-5))).withColumn("w0", F.transform("w", lambda x: x * F.col("nu") / nu0)).withColumn("nu0", nu0)


def priors_after_split(gmm: DataFrame, share: float = 0.5) -> DataFrame:
    """The priors of a split's halves: their own means and precisions, trusted by `share` of their weight; alpha0 stays."""
    nu0 = F.greatest(share * F.col("n_k"), F.lit(3.0))
    return gmm.withColumn("m0", F.col("m")).withColumn("beta0", F.greatest(share * F.col("n_k"), F.lit(1e-5))).withColumn("w0", F.transform("w", lambda x: x * F.col("nu") / nu0)).withColumn("nu0", nu0)


def priors_as_found(gmm: DataFrame) -> DataFrame:
    """The posteriors become priors as they are; alpha0 stays."""
    return gmm.withColumn("m0", F.col("m")).withColumn("beta0", F.col("beta")).withColumn("nu0", F.col("nu")).withColumn("w0", F.col("w"))


def from_nuclei(moments: DataFrame) -> DataFrame:
    """Components without priors of a frame's nuclei (frame, id, weight, x, y, z, w: packed precision): (frame, k, id, n_k, alpha, beta, nu, m, w, alpha0, beta0, nu0, m0, w0), k from 0 in id order."""
    n = F.greatest("weight", F.lit(4.0))
    m, w = F.array(*AXES), F.transform("w", lambda x: x / n)
    k = F.row_number().over(Window.partitionBy("frame").orderBy("id")) - 1
    zero = F.lit(0.0)
    return moments.select("frame", k.cast("long").alias("k"), "id", F.col("weight").alias("n_k"), F.col("weight").alias("alpha"), F.col("weight").alias("beta"), n.alias("nu"), m.alias("m"), w.alias("w"), zero.alias("alpha0"), zero.alias("beta0"), F.lit(4.0).alias("nu0"), m.alias("m0"), w.alias("w0"))


def pair_divergence(voxels: DataFrame, resp: DataFrame, gmm: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame, k1, k2, score): how far what two components of pairs (frame, k1, k2) share of the intensity is from their two Gaussians together, weighted by alpha."""
    g = gmm.select("frame", "k", "alpha", "nu", "m", "w")
    both = pairs.select("frame", "k1", "k2", F.explode(F.array("k1", "k2")).alias("k")).join(g, ["frame", "k"])
    share = F.col("alpha") / F.sum("alpha").over(Window.partitionBy("frame", "k1", "k2"))
    both = both.withColumn("share", share)
    held = resp.filter(F.col("r") > 1e-3).join(pairs.select("frame", "k1", "k2", F.explode(F.array("k1", "k2")).alias("k")), ["frame", "k"]).groupBy("frame", "k1", "k2", "sv_id").agg(F.sum("r").alias("r"))
    met = held.join(voxels, ["frame", "sv_id"])
    d = quadratic_form([F.col(c) - F.col("m")[i] for i, c in enumerate(AXES)], F.col("w")) * F.col("nu")
    density = F.col("share") * F.sqrt(determinant(F.col("w")) * F.pow("nu", F.lit(3))) * float((2 * np.pi) ** -1.5) * F.exp(-0.5 * d)
    each = met.join(both, ["frame", "k1", "k2"]).groupBy("frame", "k1", "k2", "sv_id", *AXES).agg(F.first(F.col("r") * F.col("v")).alias("q"), F.sum(density).alias("p"))
    q = F.col("q")
    return each.filter((q > 0) & (F.col("p") > 0)).groupBy("frame", "k1", "k2").agg((F.sum(q * (F.log(q) - F.log("p"))) / F.sum(q) - F.log(F.sum(q))).alias("score"))


def model_penalty(gmm: DataFrame, n: Column, parameters: int = 10) -> DataFrame:
    """(frame, penalty): description length of the live components: half their parameters times log of the share of data, and of the data."""
    live = gmm.filter("alpha > 0").withColumn("share", F.col("alpha") / F.sum("alpha").over(Window.partitionBy("frame")))
    k = F.count("*")
    return live.groupBy("frame").agg((parameters / 2.0 * F.sum(F.log(n * F.col("share") / 12.0)) + k / 2.0 * F.log(F.first(n) / 12.0) + k * (parameters + 1) / 2.0).alias("penalty"))


def _full(w: np.ndarray) -> np.ndarray:
    return np.stack([w[..., [0, 1, 2]], w[..., [1, 3, 4]], w[..., [2, 4, 5]]], -2)


def _packed(w: np.ndarray) -> np.ndarray:
    return np.stack([w[..., i, j] for i, j in PAIRS], -1)


def regularised(w: np.ndarray, least: float, most: float, eccentricity: float, scale: Sequence[float] = (1.0, 1.0, 1.0), flat: bool = False) -> np.ndarray:
    """Packed precisions with eigenvalues, in units of the scale, kept to [least, most] and to the eccentricity between any two; flat: without xz and yz."""
    s = np.outer(scale, scale)
    a = _full(np.asarray(w, float)) / s
    if flat:
        a[..., [0, 1, 2, 2], [2, 2, 0, 1]] = 0
    values, vectors = np.linalg.eigh(a)
    values = np.clip(values, least, most)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        low, high = np.minimum(values[..., i], values[..., j]), np.maximum(values[..., i], values[..., j])
        capped = np.minimum(high, low * eccentricity)
        first = values[..., i] >= values[..., j]
        values[..., i] = np.where(first, capped, values[..., i])
        values[..., j] = np.where(first, values[..., j], capped)
    return _packed((vectors * values[..., None, :]) @ np.swapaxes(vectors, -1, -2) * s)


def regularise(df: DataFrame, least: float, most: float, eccentricity: float, scale: Sequence[float] = (1.0, 1.0, 1.0), column: str = "w") -> DataFrame:
    """df with its packed precisions regularised; null stays null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(w: pd.Series) -> pd.Series:
        out, ok = pd.Series([None] * len(w), dtype=object), w.notna().to_numpy()
        if ok.any():
            got = regularised(np.stack(w[ok].to_list()), least, most, eccentricity, scale)
            for i, row in zip(np.flatnonzero(ok), got):
                out.iat[i] = row
        return out

    return df.withColumn(column, run(F.col(column)))


def eigen3(df: DataFrame, column: str = "w") -> DataFrame:
    """df with eigenvalues array(3), ascending, and vectors array(9), row i being the i-th one with its largest part positive."""
    kind = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("vectors", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def run(w: pd.Series) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(_full(np.stack(w.to_list()).astype(float)))
        rows = np.swapaxes(vectors, -1, -2)
        big = np.take_along_axis(rows, np.abs(rows).argmax(-1)[..., None], -1)
        rows = rows * np.sign(big)
        return pd.DataFrame({"values": list(values), "vectors": list(rows.reshape(len(rows), 9))})

    return df.withColumn("e", run(F.col(column))).select(*df.columns, F.col("e.values").alias("eigenvalues"), F.col("e.vectors").alias("vectors"))


def split(gmm: DataFrame) -> DataFrame:
    """Each component as two: moved by one standard deviation both ways along its longest axis, with half of alpha and n_k; half is 0 or 1."""
    e = eigen3(gmm)
    sd = 1.0 / F.sqrt(F.get(F.col("eigenvalues"), F.lit(0)) * F.col("nu"))
    pair = e.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("sign", F.when(F.col("half") == 0, -1.0).otherwise(1.0))
    m = F.array(*[F.col("m")[i] + F.col("sign") * sd * F.col("vectors")[i] for i in range(3)])
    round_w = F.get(F.col("eigenvalues"), F.lit(2))
    pair = pair.withColumn("m", m).withColumn("w", F.array(round_w, F.lit(0.0), F.lit(0.0), round_w, F.lit(0.0), round_w)).withColumn("alpha", F.col("alpha") / 2)
    return pair.select(*gmm.columns, "half")


def fit_frame(x: np.ndarray, v: np.ndarray, owner: np.ndarray, n_regions: int, prior: dict, nearest: int, iterations: int, tolerance: float, limits: tuple[float, float, float]) -> tuple[dict, np.ndarray, np.ndarray, list[float]]:
    """Variational EM of one frame: posteriors, candidate components of each region, responsibilities, log likelihoods."""
    k = len(prior["alpha0"])
    post = {"alpha": prior["alpha0"].copy(), "beta": prior["beta0"].copy(), "nu": prior["nu0"].copy(), "m": prior["m0"].copy(), "w": prior["w0"].copy()}
    weight = np.bincount(owner, v, n_regions)
    centre = np.stack([np.bincount(owner, v * x[:, a], n_regions) for a in range(3)], 1) / np.maximum(weight, 1e-300)[:, None]
    history: list[float] = []
    for _ in range(iterations):
        live = np.flatnonzero(post["alpha"] > 0)
        d2 = ((centre[:, None, :] - post["m"][None, live]) ** 2).sum(-1)
        near = live[np.argsort(d2, 1, kind="stable")[:, : min(nearest, len(live))]]
        det = np.linalg.det(_full(post["w"]))
        e_pi = np_digamma(np.maximum(post["alpha"], 1e-300)) - np_digamma(post["alpha"].sum())
        e_det = sum(np_digamma((post["nu"] - i) / 2) for i in range(3)) + 3 * np.log(2) + np.log(np.maximum(det, 1e-300))
        pi = post["alpha"] / post["alpha"].sum()
        s = np.zeros((n_regions, near.shape[1]))
        density = np.zeros(len(x))
        for c in range(near.shape[1]):
            g = near[owner, c]
            diff = x - post["m"][g]
            q = np.einsum("ni,nij,nj->n", diff, _full(post["w"][g]), diff)
            s[:, c] = np.bincount(owner, e_pi[g] + 0.5 * e_det[g] - 0.5 * (3 / post["beta"][g] + post["nu"][g] * q), n_regions)
            density += pi[g] * np.sqrt(np.maximum(det[g], 0) * post["nu"][g] ** 3) * (2 * np.pi) ** -1.5 * np.exp(-0.5 * post["nu"][g] * q)
        r = np.exp(s - s.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        history.append(float((v * np.log(np.maximum(density, 1e-300))).sum()))
        now = history[-1]
        if any(abs(now - old) <= tolerance * abs(old) for old in history[-4:-1]):
            break
        n, sx, sxx = np.zeros(k), np.zeros((k, 3)), np.zeros((k, 3, 3))
        for c in range(near.shape[1]):
            g = near[owner, c]
            w = v * r[owner, c]
            np.add.at(n, g, w)
            np.add.at(sx, g, w[:, None] * x)
            np.add.at(sxx, g, w[:, None, None] * x[:, :, None] * x[:, None, :])
        mean = sx / np.maximum(n, 1e-300)[:, None]
        gap = np.where(n[:, None] > 0, mean - prior["m0"], 0)
        b0 = prior["beta0"]
        spread = sxx - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        inv = np.linalg.inv(_full(prior["w0"])) + spread + (b0 * n / (b0 + n))[:, None, None] * gap[:, :, None] * gap[:, None, :]
        nu = prior["nu0"] + n
        w = np.stack([regularised(a, limits[0] / f, limits[1] / f, limits[2]) for a, f in zip(_packed(np.linalg.inv(inv)), nu)])
        alpha = np.maximum(prior["alpha0"] + n, 0)
        alive = (alpha / alpha.sum() >= DEAD_SHARE) & (post["alpha"] > 0) & np.isfinite(w).all(1)
        post = {"alpha": np.where(alive, alpha, 0), "beta": b0 + n, "nu": nu, "m": (b0[:, None] * prior["m0"] + sx) / (b0 + n)[:, None], "w": w}
    return post, near, r, history


def fit(voxels: DataFrame, gmm: DataFrame, nearest: int = 5, iterations: int = 400, tolerance: float = 1e-6, limits: tuple[float, float, float] = (1e-4, 1e3, 100.0)) -> DataFrame:
    """(frame, sv_id, k, r, m, alpha, iterations): each frame fitted in one task to its voxels from its priors."""
    names = ["alpha0", "beta0", "nu0", "m0", "w0"]
    packed_gmm = gmm.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("k", *names))).alias("g"))
    rows = voxels.select("frame", "sv_id", *[F.col(c).cast("double") for c in AXES], F.col("v").cast("double"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["frame", "sv_id", "k", "r", "m", "alpha", "iterations"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        g = right.g.iloc[0]
        ks = [a["k"] for a in g]
        prior = {c: np.array([np.asarray(a[c], float) for a in g]) for c in names}
        ids, owner = np.unique(left.sv_id.to_numpy(), return_inverse=True)
        post, near, r, history = fit_frame(left[list(AXES)].to_numpy(), left.v.to_numpy(), owner, len(ids), prior, nearest, iterations, tolerance, limits)
        out = [(key[0], ids[i], ks[near[i, c]], r[i, c], post["m"][near[i, c]], post["alpha"][near[i, c]], len(history)) for i in range(len(ids)) for c in range(near.shape[1])]
        return pd.DataFrame(out, columns=columns)

    schema = f"frame {dict(voxels.dtypes)['frame']}, sv_id {dict(voxels.dtypes)['sv_id']}, k {dict(gmm.dtypes)['k']}, r double, m array<double>, alpha double, iterations int"
    return rows.groupBy("frame").cogroup(packed_gmm.groupBy("frame")).applyInPandas(run, schema)


def kalman(tracks: DataFrame, process: float, measured: float) -> DataFrame:
    """Constant-velocity Kalman filter along each track (track, frame, x, y, z): (track, frame, predicted, filtered array(3)). Axes are independent and share their gains."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        z = pdf[list(AXES)].to_numpy(float)
        f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
        q = process * np.array([[0.25, 0.5], [0.5, 1.0]])
        state, cov = np.stack([z[0], np.zeros(3)]), np.diag([measured, 1.0])
        predicted, filtered = [z[0]], [z[0]]
        for row in z[1:]:
            state, cov = f @ state, f @ cov @ f.T + q
            predicted.append(state[0].copy())
            gain = cov @ h.T / (h @ cov @ h.T + measured)
            state = state + gain @ (row[None, :] - h @ state)
            cov = (np.eye(2) - gain @ h) @ cov
            filtered.append(state[0].copy())
        return pd.DataFrame({"track": pdf.track, "frame": pdf.frame, "predicted": predicted, "filtered": filtered})

    kinds = dict(tracks.dtypes)
    return tracks.groupBy("track").applyInPandas(run, f"track {kinds['track']}, frame {kinds['frame']}, predicted array<double>, filtered array<double>")


def flow_prediction(points: DataFrame, flow: DataFrame, forward: bool, radius: Sequence[int] = (2, 2, 1)) -> DataFrame:
    """points (id, x, y, z) moved by the mean flow (x, y, z, vx, vy, vz) in the box around their rounded place; against it if forward. Where no flow is known a point stays."""
    boxed = points.select("id", *AXES, *[F.round(c).cast("int").alias(f"b{c}") for c in AXES])
    for c, r in zip(AXES, radius):
        boxed = boxed.withColumn(f"b{c}", F.explode(F.sequence(F.col(f"b{c}") - r, F.col(f"b{c}") + r)))
    f = flow.select(*[F.col(c).alias(f"b{c}") for c in AXES], "vx", "vy", "vz")
    mean = boxed.join(f, [f"b{c}" for c in AXES]).groupBy("id").agg(*[F.avg(f"v{c}").alias(f"v{c}") for c in AXES])
    sign = -1 if forward else 1
    return points.join(mean, "id", "left").select("id", *[(F.col(c) + sign * F.coalesce(f"v{c}", F.lit(0.0))).alias(c) for c in AXES])
