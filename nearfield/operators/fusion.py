"""Hybrid search: results of several rankings, intersected or fused by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank constant of reciprocal rank fusion.
RANK_CONSTANT = 60


def within(found: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of one result whose ids the other has too."""
    return found.join(ids.select(key).distinct(), key, "left_semi").select(*found.columns)


def fused(rankings: list[DataFrame], key: str, order: list[str], k: int) -> DataFrame:
    """key and rrf (rounded): the sum of 1 / (60 + rank) over rankings, best k first, ties by key.

    Each ranking is a short list (k or so rows) whose column order[i] ranks it
    ascending, ties by key.
    """
    parts = None
    for df, column in zip(rankings, order):
        place = F.row_number().over(Window.orderBy(column, key))  # a ranking is a bounded top list
        part = df.select(F.col(key), (1.0 / (RANK_CONSTANT + place)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.round(F.sum("part"), 9).alias("rrf")).orderBy(F.desc("rrf"), key).limit(k)


def latest(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with delta's rows in place of those of the same key."""
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(delta)
