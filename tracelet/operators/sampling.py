"""Draws from distributions as column expressions, and densities.

Draws are made from rand(seed): the same rows in the same partitions give the
same draws. Gamma, Wishart and multivariate normal draws go through numpy in
Arrow batches, each row seeded by its key, so they don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.functions.geometry import PAIRS, determinant, gaussian_log_density, inverse


def uniform(low: float, high: float, seed: int) -> Column:
    return low + (high - low) * F.rand(seed)


def normal(mean: float, deviation: float, seed: int) -> Column:
    return mean + deviation * F.randn(seed)


def exponential(rate: float, seed: int) -> Column:
    return -F.log(1 - F.rand(seed)) / rate


def bernoulli(share: float, seed: int) -> Column:
    return (F.rand(seed) < share).cast("int")


def geometric(share: float, seed: int) -> Column:
    """Failures before the first success."""
    if share >= 1:
        return F.lit(0)
    return F.floor(F.log(1 - F.rand(seed)) / math.log(1 - share)).cast("long")


def from_weights(weights: Sequence[float], seed: int) -> Column:
    """A position drawn in proportion to the weights: the first whose running sum exceeds the draw."""
    total, up, steps = sum(weights), 0.0, []
    for w in weights:
        up += w / total
        steps.append(up)
    # bound to a variable, one draw is held against all steps
    passed = F.transform(F.array(F.rand(seed)), lambda u: F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= u)))
    return F.least(F.get(passed, F.lit(0)), F.lit(len(weights) - 1))


def binomial(trials: int, share: float, seed: int) -> Column:
    return from_weights([math.comb(trials, k) * share**k * (1 - share) ** (trials - k) for k in range(trials + 1)], seed)


def poisson(mean: float, seed: int) -> Column:
    """By its inverse distribution, up to where less than 1e-12 is left."""
    weights, p, k = [], math.exp(-mean), 0
    while k <= mean or p > 1e-12:
        weights.append(p)
        k += 1
        p *= mean / k
    return from_weights(weights, seed)


def _rng(key: int, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF])


def gamma(df: DataFrame, shape: str, rate: str, seed: int, key: str = "id", name: str = "draw") -> DataFrame:
    @F.pandas_udf("double")
    def run(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_rng(i, seed).gamma(x, 1 / y) for i, x, y in zip(k, a, b)])

    return df.withColumn(name, run(key, shape, rate))


def multinormal(df: DataFrame, mean: str, precision: str, seed: int, key: str = "id", name: str = "draw") -> DataFrame:
    """3-d draws; the precision is packed."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(k: pd.Series, m: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for i, a, p in zip(k, m, w):
            full = np.zeros((3, 3))
            for (r, c), x in zip(PAIRS, p):
                full[r, c] = full[c, r] = x
            out.append(np.asarray(a) + np.linalg.solve(np.linalg.cholesky(full).T, _rng(i, seed).standard_normal(3)))
        return pd.Series(out)

    return df.withColumn(name, run(key, mean, precision))


def wishart(df: DataFrame, scale: str, nu: str, seed: int, key: str = "id", name: str = "draw") -> DataFrame:
    """Packed 3x3 draws of W(scale, nu), nu > 2, by Bartlett's decomposition."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(k: pd.Series, w: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for i, p, v in zip(k, w, n):
            full = np.zeros((3, 3))
            for (r, c), x in zip(PAIRS, p):
                full[r, c] = full[c, r] = x
            rng = _rng(i, seed)
            a = np.tril(rng.standard_normal((3, 3)), -1) + np.diag([math.sqrt(rng.chisquare(v - j)) for j in range(3)])
            la = np.linalg.cholesky(full) @ a
            s = la @ la.T
            out.append([s[r, c] for r, c in PAIRS])
        return pd.Series(out)

    return df.withColumn(name, run(key, scale, nu))


def multinormal_log_density(x: Sequence[Column], mean: Column, precision: Column) -> Column:
    return gaussian_log_density([c - mean[i] for i, c in enumerate(x)], precision)


def _log_gamma(nu: Column) -> Column:
    """For nu > 0: stepped up by 8, then Stirling's series."""
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.log(nu + i))
    y = nu + 8.0
    z = 1.0 / (y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - steps


def wishart_log_density(w: Column, scale: Column, nu: Column) -> Column:
    """Of packed 3x3 matrices."""
    inv = inverse(scale)
    trace = inv[0] * w[0] + inv[3] * w[3] + inv[5] * w[5] + 2.0 * (inv[1] * w[1] + inv[2] * w[2] + inv[4] * w[4])
    many = 1.5 * math.log(math.pi) + _log_gamma(nu / 2.0) + _log_gamma((nu - 1.0) / 2.0) + _log_gamma((nu - 2.0) / 2.0)
    return 0.5 * (nu - 4.0) * F.log(determinant(w)) - 0.5 * trace - nu / 2.0 * F.log(determinant(scale)) - nu * 1.5 * math.log(2.0) - many
