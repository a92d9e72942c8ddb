"""Two-stage search: a cheap code picks candidates, full vectors order them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Metric
from ..functions import codes, pq
from ..functions.distance import inner_product, vector
from .knn import check_k, with_distance


def encoded(df: DataFrame, col: str, dimensions: int, name: str = "code") -> DataFrame:
    return df.withColumn(name, codes.ternary_encode(col, dimensions))


def query_code(query: Sequence[float]) -> Column:
    """The query's ternary code as a literal, encoded once."""
    pos, neg = codes.ternary_planes(np.asarray([query], np.float64))
    planes = [F.array(*(F.lit(int(np.int64(w.astype(np.int64)))) for w in p[0])) for p in (pos, neg)]
    return F.struct(planes[0].alias("pos"), planes[1].alias("neg"))


def ternary_top(df: DataFrame, code: str, query: Sequence[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k rows whose codes agree most with the query's, by (score descending, id)."""
    check_k(k)
    return df.withColumn("score", codes.ternary_dot(F.col(code), query_code(query))).orderBy(F.desc("score"), id_col).limit(k)


def two_stage(df: DataFrame, col: str, query: Sequence[float], k: int, breadth: int, metric: str | Metric = Metric.COSINE, id_col: str = "vec_id", code: str | None = None) -> DataFrame:
    """Exact top k of the max(breadth, k) best by ternary code; with `code` the codes are read, else made on the way."""
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        raise ValueError("ternary codes do not approximate L2")
    check_k(k)
    rows = df.where(F.col(col).isNotNull())
    if code is None:
        rows, code = encoded(rows, col, len(query), "__code"), "__code"
    first = ternary_top(rows, code, query, max(breadth, k), id_col)
    return with_distance(first, col, query, metric).orderBy("dist", id_col).limit(k).select(*df.columns, "score", "dist")


def int8_two_stage(df: DataFrame, col: str, query: Sequence[float], k: int, breadth: int, metric: str | Metric = Metric.COSINE, id_col: str = "vec_id") -> DataFrame:
    """The same with int8 elements and their inner product in the first stage."""
    check_k(k)
    quick = F.round(inner_product(codes.int8_decode(codes.int8_encode(col)), list(query)), 6)
    first = df.where(F.col(col).isNotNull()).withColumn("score", quick).orderBy(F.desc("score"), id_col).limit(max(breadth, k))
    return with_distance(first, col, query, metric).orderBy("dist", id_col).limit(k)


def sign_two_stage(df: DataFrame, col: str, query: Sequence[float], k: int, breadth: int, id_col: str = "vec_id") -> DataFrame:
    """The same with sign bits and their Hamming distance, for cosine."""
    check_k(k)
    own = codes.sign_bits(vector(list(query)), len(query))
    first = df.where(F.col(col).isNotNull()).withColumn("apart", codes.hamming(codes.sign_bits(col, len(query)), own)).orderBy("apart", id_col).limit(max(breadth, k))
    return with_distance(first, col, query, Metric.COSINE).orderBy("dist", id_col).limit(k)


def pq_two_stage(df: DataFrame, col: str, query: Sequence[float], k: int, breadth: int, metric: str | Metric = Metric.COSINE, id_col: str = "vec_id", groups: int = 16, books: pq.Codebooks | None = None, coded: DataFrame | None = None) -> DataFrame:
    """The same with product codes in the first stage; books and coded (id, code) are made on the way unless given."""
    check_k(k)
    books = books or pq.fit(df, col, groups, metric, id_col)
    coded = coded if coded is not None else pq.encoded(df, col, books, id_col)
    first = pq.scored(coded, books, np.asarray(query, np.float64), id_col).orderBy("score", id_col).limit(max(breadth, k))
    rows = df.join(F.broadcast(first), id_col)  # max(breadth, k) rows
    return with_distance(rows, col, query, metric).orderBy("dist", id_col).limit(k)
