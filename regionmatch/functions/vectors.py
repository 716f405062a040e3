"""Array-column algebra for feature vectors and histograms (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double") * k)


def unit(a: Column, eps: float = 1e-6) -> Column:
    """The vector divided by its length plus a small constant."""
    return scale(a, 1.0 / (norm(a) + eps))


def share(a: Column, eps: float = 1e-6) -> Column:
    """A histogram divided by its total plus a small constant."""
    return scale(a, 1.0 / (total(a) + eps))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))))


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def bhattacharyya(a: Column, b: Column) -> Column:
    root = lambda v: F.sqrt(F.greatest(v.cast("double"), F.lit(0.0)))
    return total(F.zip_with(a, b, lambda p, q: root(p) * root(q)))

