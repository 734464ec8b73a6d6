"""Vector and rank functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; callers make sure that neither norm is 0."""
    return dot(a, b) / (norm(a) * norm(b))


def usability(vec: Column, dimensions: int) -> Column:
    """ok, zero (no direction) or invalid (null, other length, null or non-finite component)."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vec.isNull() | (F.size(vec) != dimensions) | odd, "invalid").when(norm(vec) == 0, "zero").otherwise("ok")


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Sum of 1 / (k + rank) over the ranks that are present."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (F.lit(k) + r), F.lit(0.0))
    return total
