"""Checks of polygon annotations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def crosses(a, b, c, d) -> bool:
    """Segments ab and cd share a point."""
    t = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if t[0] * t[1] < 0 and t[2] * t[3] < 0:
        return True
    return any(v == 0 and _on(p, q, r) for v, p, q, r in ((t[0], a, b, c), (t[1], a, b, d), (t[2], c, d, a), (t[3], c, d, b)))


def is_simple(points) -> bool:
    """Three or more finite points whose sides meet only at shared corners."""
    if points is None or len(points) < 3 or any(p is None or len(p) != 2 or any(v is None or v != v for v in p) for p in points):
        return False
    p = [tuple(map(float, q)) for q in points]
    n = len(p)
    if len(set(p)) < n:
        return False
    return not any(crosses(p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


@F.pandas_udf(T.BooleanType())
def simple_polygon(points: pd.Series) -> pd.Series:
    """Whether a polygon is simple; false for null."""
    return points.map(is_simple, na_action=None)
