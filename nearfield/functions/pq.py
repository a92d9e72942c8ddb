"""Product quantisation: one byte for each group of dimensions, distances from tables.

A vector is cut into equal groups; each group is replaced by the number of its
nearest centroid among up to 256, which are fitted on a bounded sample. The
distance of a query to a code is a sum of looked-up parts, one for each group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Metric
from ..operators.blocks import matrix

#: Most rows that codebooks are fitted on: those whose ids' hashes are smallest.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 256, 12


@dataclass(frozen=True)
class Codebooks:
    """groups x centroids x (dimensions / groups); for cosine, of vectors of length one."""

    centroids: np.ndarray
    metric: Metric

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """Vectors as groups of dimensions."""
        if self.metric is Metric.COSINE:
            norms = np.sqrt((x**2).sum(1, keepdims=True))
            x = x / np.where(norms == 0, 1, norms)
        return x.reshape(len(x), self.centroids.shape[0], -1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """n x groups bytes; ties to the lower number."""
        parts = self.prepared(x)
        out = np.empty(parts.shape[:2], np.uint8)
        for g, c in enumerate(self.centroids):
            out[:, g] = ((c**2).sum(1)[None] - 2 * parts[:, g] @ c.T).argmin(1)
        return out

    def table(self, query: np.ndarray) -> np.ndarray:
        """groups x centroids: what each code byte adds to the distance (squared for L2, less 1 for cosine)."""
        q = self.prepared(np.asarray(query, np.float64)[None])[0]
        if self.metric is Metric.L2:
            return ((self.centroids - q[:, None]) ** 2).sum(-1)
        return -(self.centroids * q[:, None]).sum(-1)


def fit(df: DataFrame, col: str, groups: int, metric: str | Metric = Metric.L2, id_col: str = "vec_id", sample: int = SAMPLE) -> Codebooks:
    """Codebooks by k-means in each group, on at most `sample` rows; the same rows give the same books."""
    metric = Metric.parse(metric)
    chosen = df.where(F.col(col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(col).toArrow()
    x = matrix(chosen.column(col))
    if not len(x) or x.shape[1] % groups:
        raise ValueError("the number of groups must divide the dimensions, and there must be rows")
    parts = Codebooks(np.zeros((groups, 1, x.shape[1] // groups)), metric).prepared(x)
    n = min(CENTROIDS, len(x))
    books = parts[np.linspace(0, len(x) - 1, n).astype(int)].transpose(1, 0, 2).copy()
    for g in range(groups):
        for _ in range(ROUNDS):
            own = ((books[g] ** 2).sum(1)[None] - 2 * parts[:, g] @ books[g].T).argmin(1)
            count = np.bincount(own, minlength=n)
            sums = np.zeros_like(books[g])
            np.add.at(sums, own, parts[:, g])
            books[g][count > 0] = sums[count > 0] / count[count > 0][:, None]
    return Codebooks(books, metric)


def encoded(df: DataFrame, col: str, books: Codebooks, id_col: str = "vec_id", name: str = "code") -> DataFrame:
    """id and code (binary, a byte for each group) of the rows with a vector."""
    rows = df.where(F.col(col).isNotNull()).select(id_col, col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = books.encode(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], [id_col, name])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{name}` binary")


def scored(codes: DataFrame, books: Codebooks, query: np.ndarray, id_col: str = "vec_id", name: str = "code") -> DataFrame:
    """id and score: the looked-up distance of each code to the query, rounded."""
    table = books.table(query)
    group = np.arange(len(table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(table))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table[group[None], own].sum(1).round(6))], [id_col, "score"])

    return codes.select(id_col, name).mapInArrow(run, f"`{id_col}` {codes.schema[id_col].dataType.simpleString()}, score double")
