"""Vectors as array columns: all built-in higher-order functions, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12))))


def scale(v: Column, by) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(v, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def truncate(v: Column, dim) -> Column:
    """The first ``dim`` numbers (Matryoshka)."""
    return F.slice(v, F.lit(1), dim if isinstance(dim, Column) else F.lit(dim))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation across the dimensions of two vectors."""
    centred = lambda v: let(_mean(v), lambda m: F.transform(v, lambda x: x - m))
    return cosine(centred(a), centred(b))


def sum_rows(rows: Column) -> Column:
    """Elementwise sum of an array of vectors; NULL if there are none."""
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, F.lit(0)), lambda s, r: add(s, r))


def mean_rows(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, scale(sum_rows(rows), 1 / F.size(rows)))


def cls_pool(hidden: Column) -> Column:
    return F.get(hidden, F.lit(0))


def last_pool(hidden: Column) -> Column:
    return F.get(hidden, F.size(hidden) - 1)


def span_pool(hidden: Column, start: Column, end: Column) -> Column:
    """Mean of the vectors from ``start`` up to ``end`` (0-based, end excluded); NULL for an empty span."""
    return F.when(end > start, mean_rows(F.slice(hidden, start + 1, end - start)))
