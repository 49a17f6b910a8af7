"""Column expressions over ARRAY<FLOAT|DOUBLE> vectors (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    sq = F.transform(as_double(v), lambda x: x * x)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); NULL when either norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """v / |v|; elements are NULL for the zero vector."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.try_divide(x, n))


def round6(c: Column) -> Column:
    return F.round(c, 6)
