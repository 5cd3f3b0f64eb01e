"""Column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hadamard(a: Column | str, b: Column | str) -> Column:
    """Elementwise product over 1e-8 + the product of the norms; its sum is the cosine."""
    scale = 1e-8 + norm(a) * norm(b)
    return F.transform(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda z: z / scale)


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def l1(a: Column | str) -> Column:
    """Scaled to sum 1; zeros stay."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
