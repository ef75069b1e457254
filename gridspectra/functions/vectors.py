"""Column functions over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str, eps: float = 1e-12) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(eps)))


def argmax(a: Column | str) -> Column:
    """Place, from 0, of the first largest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1
