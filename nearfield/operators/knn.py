"""Exact nearest neighbours of one query, with filters before or after, and within a radius.

Distances are rounded to ROUND digits and ties go to the lower id, so results
do not depend on the order of summation or of partitions.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Metric
from ..functions.distance import Vector, distance

ROUND = 6


def check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k must be a positive integer")


def with_distance(df: DataFrame, col: str, query: Vector, metric: str | Metric = Metric.L2, name: str = "dist") -> DataFrame:
    """df with the rounded distance of each row; rows without a vector have none."""
    return df.withColumn(name, F.round(distance(col, query, metric), ROUND))


def knn(df: DataFrame, col: str, query: Sequence[float], k: int, metric: str | Metric = Metric.L2, id_col: str = "vec_id", where: Column | str | None = None, filter_mode: str = "pre", allowed: DataFrame | None = None, overfetch: float = 1.0, warn: bool = False) -> DataFrame:
    """The k rows nearest to query, ordered by (dist, id).

    where is applied before the search (``pre``, exact) or to its k rows
    (``post``, which may leave fewer); with overfetch, ``post`` searches
    k * overfetch rows, filters, and keeps k. allowed (a table of ids) restricts
    the search to those ids. warn runs the query and warns if it gives under k.
    """
    check_k(k)
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode must be 'pre' or 'post'")
    if overfetch < 1:
        raise ValueError("overfetch must be at least 1")
    where = F.expr(where) if isinstance(where, str) else where
    rows = df.where(F.col(col).isNotNull())
    if allowed is not None:
        rows = rows.join(allowed.select(F.col(allowed.columns[0]).alias(id_col)), id_col, "left_semi").select(*df.columns)
    if where is not None and filter_mode == "pre":
        rows = rows.where(where)
    rows = with_distance(rows, col, query, metric)
    if where is not None and filter_mode == "post":
        found = rows.orderBy("dist", id_col).limit(-(-int(k * overfetch * 1000) // 1000)).where(where)
        found = found.orderBy("dist", id_col).limit(k)
    else:
        found = rows.orderBy("dist", id_col).limit(k)
    if warn and (n := found.count()) < k:
        warnings.warn(f"the search gave {n} of {k} rows", stacklevel=2)
    return found


def radius(df: DataFrame, col: str, query: Sequence[float], limit: float, metric: str | Metric = Metric.L2) -> DataFrame:
    """All rows nearer than limit; as many as there are."""
    return with_distance(df.where(F.col(col).isNotNull()), col, query, metric).where(F.col("dist") < limit)


def literal_of(df: DataFrame, col: str, id_col: str, key: int) -> list[float]:
    """One row's vector, to be a query."""
    row = df.where(F.col(id_col) == key).select(col).first()
    if row is None or row[0] is None:
        raise ValueError(f"no vector has {id_col} {key}")
    return [float(x) for x in row[0]]
