"""Vector expressions (FN-15, FN-16, EMB-3, EMB-5)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(vector), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """FN-15: clamped to [0, 1]; 0 where a norm is 0."""
    dot = _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))
    scale = norm(a) * norm(b)
    raw = F.when(scale > 0, dot / scale).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def l2_normalize(vector: Column) -> Column:
    """FN-16."""
    length = norm(vector)
    return F.when(length > 0, F.transform(_doubles(vector), lambda x: x / length)).otherwise(
        _doubles(vector)
    )


def has_width(vector: Column, width: int) -> Column:
    """EMB-3."""
    return F.coalesce(F.size(vector) == width, F.lit(False))


def invalidate(vector: Column, width: int) -> Column:
    """EMB-5: vectors of another width become NULL."""
    return F.when(F.size(vector) == width, vector)
