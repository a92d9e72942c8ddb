"""k-NN joins: for each left row, its nearest right rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Metric
from .blocks import many_nearest


def index_join(outer: DataFrame, inner: DataFrame, outer_col: str, inner_col: str, k: int, metric: str | Metric = Metric.L2, outer_id: str = "query_id", inner_id: str = "vec_id") -> DataFrame:
    """inner columns, row_number (from 1, anew for each outer row), dist, outer columns (renamed with outer_ where both have one).

    Exact; VectorIndex.join gives the same columns by the graphs of an index.
    """
    queries = outer.select(F.col(outer_id).alias("query_id"), F.col(outer_col).alias("query"))
    return with_columns(many_nearest(inner, queries, k, metric, inner_id, inner_col), outer, inner, outer_id, inner_id)


def with_columns(found: DataFrame, outer: DataFrame, inner: DataFrame, outer_id: str, inner_id: str) -> DataFrame:
    """The columns of both sides beside (query_id, inner id, dist, row_number)."""
    found = found.select(F.col("query_id").alias("__outer"), F.col(inner_id).alias("__inner"), "dist", "row_number")
    taken = set(inner.columns) | {"dist", "row_number"}
    right = outer.select(*(F.col(c).alias(f"outer_{c}" if c in taken else c) for c in outer.columns), F.col(outer_id).alias("__outer"))
    left = inner.withColumn("__inner", F.col(inner_id))
    joined = found.join(left, "__inner").join(right, "__outer")
    return joined.select(*inner.columns, "row_number", "dist", *(c for c in right.columns if c != "__outer"))


def lateral_join(outer: DataFrame, inner: DataFrame, outer_col: str, inner_col: str, k: int, metric: str | Metric = Metric.L2, outer_id: str = "query_id", inner_id: str = "vec_id") -> DataFrame:
    """(outer id, inner id, dist, row_number): the lateral subquery ordered by distance with limit k, without the columns."""
    queries = outer.select(F.col(outer_id).alias("query_id"), F.col(outer_col).alias("query"))
    return many_nearest(inner, queries, k, metric, inner_id, inner_col)


def _scored(left: DataFrame, right: DataFrame, left_col: str, right_col: str, k: int, metric: str | Metric, left_id: str, right_id: str) -> DataFrame:
    """query id, score, and row (a struct of the right columns but score) of each match."""
    queries = left.select(F.col(left_id).alias("query_id"), F.col(left_col).alias("query"))
    found = many_nearest(right, queries, k, metric, right_id, right_col)
    # the score of cosine is a similarity and that of ip the product: both the higher the better
    score = {Metric.L2: F.col("dist"), Metric.COSINE: F.round(1 - F.col("dist"), 6), Metric.IP: -F.col("dist")}[Metric.parse(metric)]
    rows = right.select(F.col(right_id).alias("__id"), F.struct(*(c for c in right.columns if c != "score")).alias("row"))
    return found.select("query_id", F.col(right_id).alias("__id"), score.alias("score"), "row_number").join(rows, "__id")


def knn_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, k: int, metric: str | Metric = "l2sq", left_id: str = "vec_id", right_id: str = "vec_id") -> DataFrame:
    """score, left_tbl (struct), right_tbl (struct without score): each left row with its k best right rows."""
    matches = _scored(left, right, left_col, right_col, k, metric, left_id, right_id)
    rows = left.select(F.col(left_id).alias("query_id"), F.struct(*left.columns).alias("left_tbl"))
    return matches.join(rows, "query_id").select("score", "left_tbl", F.col("row").alias("right_tbl"))


def knn_match(left: DataFrame, right: DataFrame, left_col: str, right_col: str, k: int, metric: str | Metric = "l2sq", left_id: str = "vec_id", right_id: str = "vec_id") -> DataFrame:
    """left columns and matches: an array of {score, row}, best first. Left rows without a vector have an empty array."""
    matches = _scored(left, right, left_col, right_col, k, metric, left_id, right_id)
    lists = matches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("row_number", "score", "row")), lambda a, b: (a["row_number"] - b["row_number"]).cast("int")).alias("m"))
    lists = lists.select("query_id", F.transform("m", lambda x: F.struct(x["score"].alias("score"), x["row"].alias("row"))).alias("matches"))  # at most k entries each
    kind = lists.schema["matches"].dataType
    return left.join(lists, left[left_id] == lists["query_id"], "left").select(*(left[c] for c in left.columns), F.coalesce("matches", F.array().cast(kind)).alias("matches"))


def ranked(df: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    """Rows whose row_number by (value, tie) in their group is at most k; Spark limits groups before the shuffle."""
    order = Window.partitionBy(group).orderBy(value, tie)
    return df.withColumn("row_number", F.row_number().over(order)).where(F.col("row_number") <= k)
