"""min_by and max_by with a count: the k args of least or greatest value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import check_k


def best_by_k(df: DataFrame, groups: Sequence[str], arg: str, value: str, k: int, highest: bool = False, name: str = "best", where: Column | None = None, filter_mode: str = "pre") -> DataFrame:
    """groups and a list of the k args with best value, best first, ties by arg; rows without a value are skipped.

    where acts as an aggregate's FILTER clause (``pre``), or leaves of the k best
    those that it holds for (``post``, which may leave fewer). A window keeps k rows of each
    group before anything is collected, so a list never holds more than k.
    Groups all of whose rows are skipped are left out; without groups there is
    always one row.
    """
    check_k(k)
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode must be 'pre' or 'post'")
    rows = df.where(F.col(value).isNotNull())
    if where is not None and filter_mode == "pre":
        rows = rows.where(where)
    holds = (where if where is not None and filter_mode == "post" else F.lit(True)).alias("__holds")
    direction = F.col(value).desc() if highest else F.col(value).asc()
    if groups:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(direction, F.col(arg)))
        top = rows.select(*groups, F.col(arg).alias("__arg"), rank.alias("__rank"), holds).where((F.col("__rank") <= k) & F.col("__holds"))
        lists = top.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("__rank", "__arg"))).alias(name))
    else:
        top = rows.orderBy(direction, F.col(arg)).limit(k).select(F.col(arg).alias("__arg"), F.col(value).alias("__value"), holds).where("__holds")
        sign = F.col("__value") * (-1 if highest else 1)
        lists = top.agg(F.array_sort(F.collect_list(F.struct(sign.alias("__rank"), "__arg"))).alias(name))
    return lists.withColumn(name, F.transform(name, lambda x: x["__arg"]))


def min_by_k(df: DataFrame, arg: str, value: str, k: int, groups: Sequence[str] = (), **more) -> DataFrame:
    return best_by_k(df, groups, arg, value, k, False, **more)


def max_by_k(df: DataFrame, arg: str, value: str, k: int, groups: Sequence[str] = (), **more) -> DataFrame:
    return best_by_k(df, groups, arg, value, k, True, **more)
