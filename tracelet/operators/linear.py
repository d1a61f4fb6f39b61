"""Small dense linear algebra by row: solving, orthonormal bases, banded systems, principal directions, distances of ellipsoids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.operators.mixture import _full, eigen3

AXES = ("x", "y", "z")
MOST_STEPS = 200


def _by_row(df: DataFrame, name: str, f: Callable[..., np.ndarray | None], *columns: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if (r := f(*[np.asarray(x, float) for x in row])) is None else r.ravel().tolist() for row in zip(*series)], dtype=object)

    return df.withColumn(name, run(*columns))


def solve(df: DataFrame, matrix: str, right: str, name: str = "solution") -> DataFrame:
    """df with the solution of each row's system: matrix (n * n, row by row) and right side (n); null for a singular one. By LU decomposition with pivots."""

    def one(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        try:
            return np.linalg.solve(a.reshape(len(b), len(b)), b)
        except np.linalg.LinAlgError:
            return None

    return _by_row(df, name, one, matrix, right)


def orthonormal(df: DataFrame, basis: str, width: int, name: str = "basis2") -> DataFrame:
    """df with the vectors of a basis (rows of `width` values) made orthonormal one after another; dependent ones become 0."""

    def one(b: np.ndarray) -> np.ndarray:
        out = b.reshape(-1, width).copy()
        for i in range(len(out)):
            size = np.linalg.norm(out[i])
            for j in range(i):
                out[i] -= (out[i] @ out[j]) * out[j]
            left = np.linalg.norm(out[i])
            out[i] = out[i] / left if left > 1e-12 * max(size, 1e-300) else 0.0
        return out

    return _by_row(df, name, one, basis)


def solve_banded(df: DataFrame, lower: str, diagonal: str, upper: str, right: str, name: str = "solution") -> DataFrame:
    """df with the solutions of tridiagonal systems: lower and upper have one value fewer than the diagonal; null where elimination meets a 0."""

    def one(lo: np.ndarray, d: np.ndarray, up: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        d, b = d.copy(), b.copy()
        for i in range(1, len(d)):
            if d[i - 1] == 0:
                return None
            share = lo[i - 1] / d[i - 1]
            d[i] -= share * up[i - 1]
            b[i] -= share * b[i - 1]
        if len(d) and d[-1] == 0:
            return None
        for i in range(len(d) - 1, -1, -1):
            b[i] = (b[i] - (up[i] * b[i + 1] if i + 1 < len(d) else 0.0)) / d[i]
        return b

    return _by_row(df, name, one, lower, diagonal, upper, right)


def principal_direction(points: DataFrame, *keys: str, centred: bool = False) -> DataFrame:
    """(keys, share, direction array(3)): the direction of the largest second moment of x, y, z by key, and its share of all. Not centred unless asked for."""
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    terms = [F.covar_pop(AXES[i], AXES[j]) if centred else F.avg(F.col(AXES[i]) * F.col(AXES[j])) for i, j in pairs]
    e = eigen3(points.groupBy(*keys).agg(F.array(*terms).alias("w")))
    v = F.col("eigenvalues")
    return e.select(*keys, F.try_divide(v[2], v[0] + v[1] + v[2]).alias("share"), F.slice("vectors", 7, 3).alias("direction"))


def _nearest_on(centre: np.ndarray, w: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The point of the ellipsoid (p - centre)' w (p - centre) <= 1 nearest to a point."""
    values, axes = np.linalg.eigh(w)
    at = axes.T @ (to - centre)
    if (values * at * at).sum() <= 1:
        return to
    # the multiplier t solves sum values * (at / (1 + t values))^2 = 1, whose left side falls
    low, high = 0.0, 1.0
    reach = lambda t: (values * (at / (1 + t * values)) ** 2).sum()
    while reach(high) > 1:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) > 1 else (low, mid)
    return centre + axes @ (at / (1 + high * values))


def ellipsoid_distance(df: DataFrame, m1: str, w1: str, m2: str, w2: str, name: str = "distance") -> DataFrame:
    """df with the distance of two ellipsoids (centre array(3), packed matrix): nearest points of the one and the other by turns; 0 where they meet."""

    @F.pandas_udf("double")
    def run(a: pd.Series, wa: pd.Series, b: pd.Series, wb: pd.Series) -> pd.Series:
        out = []
        for p, u, q, v in zip(a, _full(np.stack(wa.to_list()).astype(float)), b, _full(np.stack(wb.to_list()).astype(float))):
            p, q = np.asarray(p, float), np.asarray(q, float)
            x, gap = q, np.inf
            for _ in range(MOST_STEPS):
                y = _nearest_on(p, u, x)
                x = _nearest_on(q, v, y)
                before, gap = gap, float(np.linalg.norm(x - y))
                if before - gap <= 1e-12:
                    break
            out.append(gap if gap > 1e-9 else 0.0)
        return pd.Series(out)

    return df.withColumn(name, run(m1, w1, m2, w2))
