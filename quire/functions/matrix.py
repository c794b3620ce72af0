"""Affine maps as 6-tuples (a, b, c, d, e, f) that act on row vectors."""

from __future__ import annotations

import math

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def apply_vector(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y, m[1] * x + m[3] * y


def translate(x: float, y: float) -> Matrix:
    return (1.0, 0.0, 0.0, 1.0, x, y)


def scale(x: float, y: float) -> Matrix:
    return (x, 0.0, 0.0, y, 0.0, 0.0)


def device_size(m: Matrix) -> float:
    """Length of the image of (0, 1)."""
    return math.hypot(m[2], m[3])


def unit_square(m: Matrix) -> tuple[float, float, float, float]:
    """Bounding box of the image of the unit square."""
    return bounds([apply(m, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])


def bounds(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)
