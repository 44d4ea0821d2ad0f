"""Similarity of vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, as unequal vectors are cut to it."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine; 0 for empty or zero vectors and, if ``strict``, for unequal lengths. Null for a null vector."""
    n = norm(a) * norm(b)
    ok = (n > 0) & (F.size(a) == F.size(b)) if strict else n > 0
    return F.when(a.isNull() | b.isNull(), None).when(ok, dot(a, b) / n).otherwise(0.0)
