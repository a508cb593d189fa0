"""Vector algebra on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORM = 1e-12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(_total(F.transform(as_double(v), lambda x: x * x)))


def squared_distance(a, b) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def l2_normalize(v, clamp: bool = True) -> Column:
    """Unit vector. ``clamp`` bounds the norm from below (zero stays zero); otherwise a zero
    vector turns into NaN values."""
    length = norm(v)
    if clamp:
        divisor = F.greatest(length, F.lit(MIN_NORM))
    else:
        divisor = F.when(length == 0, F.lit(float("nan"))).otherwise(length)
    return F.transform(as_double(v), lambda x: x / divisor)


def subtract(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def cl2n(v, mean) -> Column:
    """Centre by ``mean``, then scale to unit length."""
    return l2_normalize(subtract(v, mean))


def scaled_logit(a, b, scale: float = 100.0, bias: float = 0.0) -> Column:
    return F.lit(float(scale)) * dot(a, b) + F.lit(float(bias))


def threshold_labels(logits, threshold: float = 0.5) -> Column:
    """0/1 per logit. The default compares the raw logit with 0.5, not the probability."""
    return F.transform(_col(logits), lambda x: (x > threshold).cast("int"))
