"""Least points and roots of plain Python functions: bracketing, one dimension, several by Powell's directions, bisection. For fitting a few parameters on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

GOLDEN = (np.sqrt(5) - 1) / 2


def bracket(f: Callable[[float], float], a: float, b: float, most: int = 60) -> tuple[float, float, float]:
    """Three points, the middle one lowest, found by walking downhill in growing steps."""
    if f(b) > f(a):
        a, b = b, a
    c = b + (b - a) / GOLDEN
    for _ in range(most):
        if f(c) >= f(b):
            break
        a, b, c = b, c, c + (c - b) / GOLDEN
    return (a, b, c) if a < c else (c, b, a)


def least_1d(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-10) -> float:
    """By golden sections within a bracket walked to from a and b."""
    low, _, high = bracket(f, a, b)
    x, y = high - GOLDEN * (high - low), low + GOLDEN * (high - low)
    fx, fy = f(x), f(y)
    while high - low > tolerance * (1 + abs(low) + abs(high)):
        if fx < fy:
            high, y, fy = y, x, fx
            x = high - GOLDEN * (high - low)
            fx = f(x)
        else:
            low, x, fx = x, y, fy
            y = low + GOLDEN * (high - low)
            fy = f(y)
    return (low + high) / 2


def powell(f: Callable[[np.ndarray], float], start, step: float = 1.0, tolerance: float = 1e-10, most: int = 200) -> np.ndarray:
    """Along a set of directions, one after another; the way they came together takes the place of the one that brought most."""
    at = np.asarray(start, float)
    ways = list(np.eye(len(at)))
    for _ in range(most):
        before, was, gains = at.copy(), f(at), []
        for w in ways:
            low = f(at)
            at = at + least_1d(lambda t, w=w: f(at + t * w), 0.0, step) * w
            gains.append(low - f(at))
        if was - f(at) <= tolerance * (1 + abs(was)):
            break
        way = at - before
        if (size := np.linalg.norm(way)) > 0:
            at = at + least_1d(lambda t: f(at + t * way / size), 0.0, step) * way / size
            ways[int(np.argmax(gains))] = way / size
            if abs(np.linalg.det(np.stack(ways))) < 1e-6:
                ways = list(np.eye(len(at)))
    return at


def root(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-13) -> float:
    """Between two points where f has different signs, by halving."""
    sign = f(low) > 0
    if sign == (f(high) > 0):
        raise ValueError("no change of sign")
    while high - low > tolerance * (1 + abs(low) + abs(high)):
        mid = (low + high) / 2
        if (f(mid) > 0) == sign:
            low = mid
        else:
            high = mid
    return (low + high) / 2
