"""Distances and similarities of vector columns, as built-in expressions.

All sums are in double. A vector of other length, or with a null element, gives
an error; a null vector gives null. Cosine with a zero vector is distance 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Metric

Vector = Column | str | Sequence[float]


def vector(v: Vector) -> Column:
    """A column, a column's name, or a literal vector, as array<double>."""
    if isinstance(v, str):
        v = F.col(v)
    if not isinstance(v, Column):
        v = F.array(*(F.lit(float(x)) for x in v))
    return v.cast("array<double>")


def checked(a: Vector, b: Vector) -> tuple[Column, Column]:
    """Both vectors; evaluating the first fails where lengths differ."""
    a, b = vector(a), vector(b)
    return F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors of different dimensions"))), b


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.raise_error(F.lit("null element in a vector"))))


def inner_product(a: Vector, b: Vector) -> Column:
    a, b = checked(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def negative_inner_product(a: Vector, b: Vector) -> Column:
    return -inner_product(a, b)


def l2_distance(a: Vector, b: Vector) -> Column:
    a, b = checked(a, b)
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(a: Vector) -> Column:
    return F.sqrt(_sum(F.transform(vector(a), lambda x: x * x)))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """dot / norms within [-1, 1]; 0 if a norm is 0, which makes the distance 1."""
    norms = norm(a) * norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.nullif(norms, F.lit(0.0)))))


def cosine_distance(a: Vector, b: Vector) -> Column:
    return 1.0 - cosine_similarity(a, b)


def distance(a: Vector, b: Vector, metric: str | Metric = Metric.L2) -> Column:
    """Lower is nearer: Euclidean (with root), 1 - cosine, or the negative inner product."""
    return {Metric.L2: l2_distance, Metric.COSINE: cosine_distance, Metric.IP: negative_inner_product}[Metric.parse(metric)](a, b)


def score(a: Vector, b: Vector, metric: str | Metric = Metric.L2) -> Column:
    """What joins and matches report: the distance for l2 (lower is better), similarity or inner product (higher is better)."""
    return {Metric.L2: l2_distance, Metric.COSINE: cosine_similarity, Metric.IP: inner_product}[Metric.parse(metric)](a, b)


def higher_is_better(metric: str | Metric) -> bool:
    return Metric.parse(metric) is not Metric.L2
