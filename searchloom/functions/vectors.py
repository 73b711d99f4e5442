"""Vector expressions over ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the left in double precision."""
    product = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalised(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(as_double(v), lambda x: x / length).cast("array<float>")


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
