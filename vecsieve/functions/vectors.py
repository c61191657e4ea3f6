"""Vector expressions over ``array<double>`` columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def l2_norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _over(v: Column, norm: Column) -> Column:
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))


def safe_l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    return _over(v, l2_norm(v))


def hellinger(v: Column) -> Column:
    """Square root of the L1-normalised vector; the zero vector stays zero."""
    return F.transform(_over(v, total(F.transform(v, lambda x: F.abs(x)))), lambda x: F.sqrt(x))


def power_law(v: Column, alpha: float | None) -> Column:
    return v if alpha is None else F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(alpha)))


def project(v: Column, mean: Column, components: Column) -> Column:
    """Unit vector of (v - mean) on the component rows."""
    centred = difference(v, mean)
    return safe_l2_normalize(F.transform(components, lambda row: dot(row, centred)))


def gem(x: Column, p: float | None) -> Column:
    """Aggregate: generalised mean of values clamped to EPSILON; the maximum if p is None."""
    if p is None:
        return F.max(x)
    return F.pow(F.avg(F.pow(F.greatest(x, F.lit(EPSILON)), F.lit(p))), F.lit(1.0 / p))


def crop_box(box: Column) -> Column:
    """Corners rounded half to even."""
    return F.transform(box, lambda x: F.bround(x, 0).cast("long"))


def patch_side(length: Column, patch: int) -> Column:
    """Nearest multiple of the patch, one patch at least."""
    return F.greatest(F.lit(patch), (F.bround(length / patch, 0) * patch).cast("int"))


def input_scale(width: Column, height: Column, max_side: int, scale: float, min_side: int) -> Column:
    """Resize factor that caps the long side, never enlarges for it, and keeps a least short side."""
    cap = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height)) * scale
    return F.greatest(cap, F.lit(float(min_side)) / F.least(width, height))
