"""Vector expressions over arrays of numbers. Components are taken as doubles before any arithmetic; a null vector gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2", "l1", "chebyshev")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Zero where either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def _gaps(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """cosine: one less the similarity; dot: negated; l2, l1, chebyshev. Another name means cosine."""
    if metric == "dot":
        return -dot(a, b)
    if metric == "l2":
        return F.sqrt(_sum(F.transform(_gaps(a, b), lambda g: g * g)))
    if metric == "l1":
        return _sum(_gaps(a, b))
    if metric == "chebyshev":
        return F.coalesce(F.array_max(_gaps(a, b)), F.lit(0.0))
    return 1 - cosine(a, b)


def similarity(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """cosine and dot as they are; 1 / (1 + distance) for the others."""
    if metric in ("l2", "l1", "chebyshev"):
        return 1 / (1 + distance(a, b, metric))
    return dot(a, b) if metric == "dot" else cosine(a, b)


def normalise(v: Column | str) -> Column:
    """The vector divided by its length; one without length stays."""
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def mahalanobis(a: Column | str, b: Column | str, inverse: Column | str) -> Column:
    """sqrt(max(0, d' S d)) for d = a - b and the rows of S, an inverse covariance."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    total = _sum(F.zip_with(d, inverse, lambda x, row: x * dot(row, d)))
    return F.sqrt(F.greatest(F.lit(0.0), total))
