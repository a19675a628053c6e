"""Vector column functions; arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: str | Column, b: str | Column) -> Column:
    """V2: inner product."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: str | Column) -> Column:
    """V1: unit length; the zero vector stays zero."""
    return bind(norm(a), lambda n: F.transform(
        _c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """V2: cosine; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_pool(tokens: str | Column, mask: str | Column) -> Column:
    """V3: mean of the token vectors whose mask is set, then unit length."""
    pairs = F.arrays_zip(_c(tokens).alias("t"), _c(mask).alias("m"))
    width = F.size(F.get(_c(tokens), F.lit(0)))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(
        pairs, zero,
        lambda acc, p: F.zip_with(acc, p["t"], lambda s, x: s + x.cast("double") * p["m"].cast("double")))
    weight = F.greatest(F.aggregate(_c(mask), F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    return bind(weight, lambda w: bind(F.transform(total, lambda x: x / w), normalize))


def zero_fill(vec: str | Column, dim: int) -> Column:
    """V4: a zero vector for a missing modality."""
    return F.coalesce(_c(vec), F.array_repeat(F.lit(0.0), dim).cast("array<double>"))
