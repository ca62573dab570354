"""Vector arithmetic in double precision over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / product of lengths; NULL if one of them is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine with the cosine clamped to [-1, 1]; NULL for a zero vector, so no threshold ever accepts it."""
    similarity = cosine_similarity(a, b)
    clamped = F.least(F.greatest(similarity, F.lit(-1.0)), F.lit(1.0))
    return F.when(similarity.isNotNull(), 1.0 - clamped)
