"""Column expressions of points, packed symmetric matrices and ellipsoids.

A packed symmetric 3x3 matrix is the array xx, xy, xz, yy, yz, zz.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ISOTROPIC = (1.0, 1.0, 1.0)


def _sum(terms) -> Column:
    return reduce(add, terms)


def index_to_xyz(index: Column, dx: int, dy: int) -> list[Column]:
    """x varies fastest."""
    return [index % dx, F.floor(index / dx) % dy, F.floor(index / (dx * dy))]


def xyz_to_index(x: Column, y: Column, z: Column, dx: int, dy: int) -> Column:
    return x + dx * (y + dy * z)


def squared_distance(a: Sequence[Column], b: Sequence[Column], scale: Sequence[float] = ISOTROPIC) -> Column:
    return _sum(((p - q) * s) * ((p - q) * s) for p, q, s in zip(a, b, scale))


def _packed(w: Column) -> list[Column]:
    return [w[i] for i in range(6)]


def quadratic_form(d: Sequence[Column], w: Column) -> Column:
    """d' W d of a packed symmetric W."""
    xx, xy, xz, yy, yz, zz = _packed(w)
    x, y, z = d
    return x * x * xx + y * y * yy + z * z * zz + 2.0 * (x * y * xy + x * z * xz + y * z * yz)


def mahalanobis2(a: Sequence[Column], b: Sequence[Column], w: Column) -> Column:
    return quadratic_form([p - q for p, q in zip(a, b)], w)


def determinant(w: Column) -> Column:
    xx, xy, xz, yy, yz, zz = _packed(w)
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def inverse(w: Column) -> Column:
    """Packed; null for a singular matrix."""
    xx, xy, xz, yy, yz, zz = _packed(w)
    cofactors = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
    det = determinant(w)
    return F.when(det != 0, F.array(*[c / det for c in cofactors]))


def eigenvalues2(a: Column, b: Column, d: Column) -> list[Column]:
    """Of ((a, b), (b, d)), the smaller first."""
    mid, half = (a + d) / 2.0, F.sqrt((a - d) * (a - d) / 4.0 + b * b)
    return [mid - half, mid + half]


def division_plane_distance(parent: Sequence[Column], first: Sequence[Column], second: Sequence[Column], scale: Sequence[float] = ISOTROPIC) -> Column:
    """Of the parent from the plane midway between two daughters; null if they coincide."""
    mid = [(p + q) / 2.0 for p, q in zip(first, second)]
    normal = [(p - m) * s for p, m, s in zip(first, mid, scale)]
    along = _sum(n * (p - m) * s for n, p, m, s in zip(normal, parent, mid, scale))
    size = F.sqrt(_sum(n * n for n in normal))
    return F.when(size > 0, F.abs(along) / size)


def ellipsoid_volume(w: Column, nu: Column) -> Column:
    """Of the unit Mahalanobis ellipsoid of precision nu * W."""
    return 4.0 / 3.0 * math.pi / F.sqrt(determinant(w) * nu * nu * nu)


def to_units(m: Sequence[Column], scale: Sequence[float]) -> list[Column]:
    """Pixels to units."""
    return [p * s for p, s in zip(m, scale)]


def to_pixels(m: Sequence[Column], scale: Sequence[float]) -> list[Column]:
    return [p / s for p, s in zip(m, scale)]


PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def precision_to_units(w: Column, scale: Sequence[float]) -> Column:
    return F.array(*[w[k] / (scale[i] * scale[j]) for k, (i, j) in enumerate(PAIRS)])


def precision_to_pixels(w: Column, scale: Sequence[float]) -> Column:
    return F.array(*[w[k] * (scale[i] * scale[j]) for k, (i, j) in enumerate(PAIRS)])


def gaussian_log_density(d: Sequence[Column], precision: Column) -> Column:
    """Of a 3-d normal with packed precision at offset d from its mean."""
    return 0.5 * F.log(determinant(precision)) - 1.5 * math.log(2 * math.pi) - 0.5 * quadratic_form(d, precision)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2), F.length(F.bin(n - 1)))).cast("long")


def mother_between_daughters(mother: Sequence[Column], first: Sequence[Column], second: Sequence[Column], scale: Sequence[float] = ISOTROPIC, tight: float = 16.0, far: float = 12.0) -> Column:
    """How well a mother lies midway on the axis of two daughters, 1 to 0: exp(-q / 2), where q is her squared offset from their middle over d2 / tight along the axis and half of that across it, d being their distance; 0 for q over `far`, null if they coincide."""
    axis = [(p - q) * s for p, q, s in zip(first, second, scale)]
    off = [((p + q) / 2.0 - m) * s for p, q, m, s in zip(first, second, mother, scale)]
    d2 = _sum(a * a for a in axis)
    along = _sum(a * o for a, o in zip(axis, off))
    along2 = F.try_divide(along * along, d2)
    q = F.try_divide(tight * (along2 + 2.0 * (_sum(o * o for o in off) - along2)), d2)
    return F.when(d2 > 0, F.when(q > far, 0.0).otherwise(F.exp(-0.5 * q)))
