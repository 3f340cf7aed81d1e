"""Vector distances as columns, in double precision, JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def constant(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def _valid(a: Column, b: Column, value: Column) -> Column:
    """Null unless both vectors have one size that isn't zero."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within 0..2; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return _valid(a, b, F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / n))))


def squared_distance(a: Column, b: Column) -> Column:
    return _valid(a, b, F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def negative_inner_product(a: Column, b: Column) -> Column:
    return _valid(a, b, -dot(a, b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, as_doubles(a)).otherwise(F.transform(as_doubles(a), lambda x: x / n))


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance, "squared": squared_distance, "inner_product": negative_inner_product}
