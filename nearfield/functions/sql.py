"""SQL names for a session: distances, codes, exact k-NN table functions, and index search and inspection.

Spark's SQL table functions cannot start a job of their own, so statements that
search an index go through `run`, which answers vector_top_k(...) and
index_info(...) first and leaves the rest of the statement to Spark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_COSINE = """CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D
  ELSE greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
       / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D))) END"""
_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"

#: name -> body over a and b, both array<double>
SCALARS = {
    "array_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "array_inner_product": _DOT,
    "array_negative_inner_product": f"-({_DOT})",
    "array_cosine_similarity": _COSINE,
    "array_cosine_distance": f"1 - ({_COSINE})",
    "array_ternary_dot": "aggregate(zip_with(a, b, (x, y) -> CAST(sign(x) * sign(y) AS BIGINT)), 0L, (s, x) -> s + x)",
}

_SCORE = """CASE lower(metric) WHEN 'l2' THEN array_distance(a, b) WHEN 'l2sq' THEN array_distance(a, b)
  WHEN 'cosine' THEN array_cosine_similarity(a, b) WHEN 'cos' THEN array_cosine_similarity(a, b)
  WHEN 'ip' THEN array_inner_product(a, b) ELSE raise_error(concat('Unknown metric ', metric)) END"""


def register(spark: SparkSession, views: Sequence[str] = (), indexes: Mapping[str, str] | None = None) -> None:
    """Creates the session's functions, table functions of some views, and names for indexes (name -> path); safe to call again."""
    for name, body in SCALARS.items():
        kind = "BIGINT" if name == "array_ternary_dot" else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_score(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, metric STRING) RETURNS DOUBLE RETURN {_SCORE}")
    for view in views:
        register_table(spark, view)
    for name, path in (indexes or {}).items():
        register_index(spark, name, path)


def register_table(spark: SparkSession, view: str, id_col: str = "vec_id", col: str = "embedding") -> None:
    """Creates knn_<view>(query, k, metric): the view's k best rows for a query vector, as a table function."""
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION knn_{view}(query ARRAY<DOUBLE>, k INT, metric STRING DEFAULT 'l2sq')
      RETURNS TABLE (id BIGINT, score DOUBLE, row_number INT)
      RETURN SELECT id, score, row_number FROM (
        SELECT id, score, row_number() OVER (ORDER BY CASE WHEN lower(knn_{view}.metric) IN ('l2', 'l2sq') THEN score ELSE -score END, id) AS row_number
        FROM (SELECT {id_col} AS id, round(vector_score(CAST({col} AS ARRAY<DOUBLE>), knn_{view}.query, knn_{view}.metric), 6) AS score FROM {view} WHERE {col} IS NOT NULL))
      WHERE row_number <= knn_{view}.k""")


def register_index(spark: SparkSession, name: str, path: str) -> None:
    """Makes an index known by name to `run`, and its info and rows readable as views index_info_<name> and index_rows_<name>."""
    from ..plans.index import VectorIndex

    index = VectorIndex(spark, path)
    spark.conf.set(f"{_INDEX}{name}", path)
    index.info().createOrReplaceTempView(f"index_info_{name}")
    index.rows().createOrReplaceTempView(f"index_rows_{name}")


_INDEX = "nearfield.index."
_CALL = re.compile(r"\b(vector_top_k|index_info)\s*\(", re.IGNORECASE)


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens before `at`, and where it ends."""
    out, depth, quote, first = [], 1, "", at
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[first:at].strip()], at + 1
        elif c == "," and depth == 1:
            out.append(text[first:at].strip())
            first = at + 1
        at += 1
    raise ValueError("a call is not closed")


def run(spark: SparkSession, statement: str) -> DataFrame:
    """spark.sql with two more table functions, for indexes made known by register_index.

    vector_top_k('name', query, k [, ef]) has the id, dist and row_number of
    about the k nearest; query is an array or a scalar subquery that gives one.
    index_info('name') has the index's info row.
    """
    from ..plans.index import VectorIndex

    while found := _CALL.search(statement):
        given, end = _arguments(statement, found.end())
        index = VectorIndex(spark, spark.conf.get(_INDEX + given[0].strip("'\"")))
        if found.group(1).lower() == "index_info":
            view = index.info()
        else:
            query, k, *ef = spark.sql(f"SELECT CAST({given[1]} AS ARRAY<DOUBLE>), {', '.join(f'CAST({x} AS INT)' for x in given[2:])}").first()
            if query is None:
                raise ValueError("the query is null")
            view = index.search(list(query), k, *ef)
        name = f"nearfield_{uuid.uuid4().hex}"
        view.createOrReplaceTempView(name)
        statement = statement[: found.start()] + name + statement[end:]
    return spark.sql(statement)
