"""Exact search of many queries at once: blocks of queries against blocks of rows.

A block of queries meets a block of vectors in one matrix product; a task keeps
the best k of each query over all its blocks, and a window over the tasks'
results gives the final k. A query set of checked size is sent to every
partition; a larger one is cut into blocks of bytes, and each pair of a query
block and a row block is a group of its own, so that no task holds more than
one block of either. The larger the blocks, the fewer copies are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Metric
from .knn import ROUND, check_k

#: A query set of at most so many bytes goes to every executor.
BROADCAST_BYTES = 32 << 20
#: Bytes of vectors in a block of either side, where both are cut into blocks.
BLOCK_BYTES = 16 << 20
#: Queries in one matrix product.
QUERIES = 1024


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as n x dims doubles; all vectors must have one length and no null element."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null element in a vector")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different dimensions")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(q: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    """len(q) x len(x) distances."""
    if q.shape[1] != x.shape[1]:
        raise ValueError("vectors of different dimensions")
    dot = q @ x.T
    if metric is Metric.IP:
        return -dot
    if metric is Metric.COSINE:
        norms = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
        return np.where(norms == 0, 1.0, 1 - np.clip(dot / np.where(norms == 0, 1, norms), -1, 1))
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * dot, 0))


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, rounded distance) of each query's k nearest, ties to the lower id."""
    d = np.round(distances(q, x, metric), ROUND)
    k = min(k, len(x))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(d <= edge)
    order = np.lexsort((rank[col], d[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep], d[row[keep], col[keep]]


def many_nearest(base: DataFrame, queries: DataFrame, k: int, metric: str | Metric = Metric.L2, id_col: str = "vec_id", col: str = "embedding", query_id: str = "query_id", query_col: str = "query", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, id, dist, row_number (from 1) of each query's k nearest rows of base; rows and queries without a vector are left out."""
    check_k(k)
    metric = Metric.parse(metric)
    base = base.where(F.col(col).isNotNull()).select(F.col(id_col).alias("id"), F.col(col).alias("v"))
    queries = queries.where(F.col(query_col).isNotNull()).select(F.col(query_id).alias("qid"), F.col(query_col).alias("q"))
    id_type, qid_type = base.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    schema = f"qid {qid_type}, id {id_type}, dist double"

    def best(qids: pa.Array, q: np.ndarray, some: Iterable[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The k nearest of all blocks (ids, vectors) to each query, as ids and distances."""
        row, ids, d = np.zeros(0, np.int64), None, np.zeros(0)
        for batch_ids, x in some:
            names = np.array(batch_ids.to_pylist())
            for a in range(0, len(q), QUERIES):
                own, column, near = nearest(q[a : a + QUERIES], x, names, k, metric)
                row, d = np.append(row, own + a), np.append(d, near)
                ids = names[column] if ids is None else np.append(ids, names[column])
            order = np.lexsort((ids, d, row))
            row, ids, d = row[order], ids[order], d[order]
            keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
            row, ids, d = row[keep], ids[keep], d[keep]
        if len(row):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), pa.array(ids.tolist(), id_arrow[0]), pa.array(d)], ["qid", "id", "dist"])

    id_arrow: list = [None]
    size, wide = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    if size * (wide or 0) * 8 <= broadcast_bytes:
        held = queries.toArrow().combine_chunks()
        qids = held.column("qid").combine_chunks()
        sent = base.sparkSession.sparkContext.broadcast((qids, matrix(held.column("q"))))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value

            def blocks() -> Iterator[tuple[pa.Array, np.ndarray]]:
                for batch in batches:
                    if batch.num_rows and len(q):
                        id_arrow[0] = batch.column(0).type
                        yield batch.column(0), matrix(batch.column(1))

            yield from best(qids, q, blocks())

        found = base.mapInArrow(scan, schema)
    else:
        rows = base.agg(F.count("*")).first()[0]
        at_once = max(1, BLOCK_BYTES // (8 * wide))
        n_q, n_b = -(-size // at_once), max(1, -(-rows // at_once))
        left = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
        right = base.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(n_b)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            found = []
            id_arrow[0] = b.column("id").type
            if a.num_rows and b.num_rows:
                a, b = a.combine_chunks(), b.combine_chunks()
                found = list(best(a.column("qid").combine_chunks(), matrix(a.column("q")), [(b.column("id").combine_chunks(), matrix(b.column("v")))]))
            return pa.Table.from_batches(found, pa.schema([("qid", a.column("qid").type), ("id", b.column("id").type), ("dist", pa.float64())]))

        found = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(meet, schema)
    order = Window.partitionBy("qid").orderBy("dist", "id")
    ranked = found.withColumn("row_number", F.row_number().over(order)).where(F.col("row_number") <= k)
    return ranked.select(F.col("qid").alias(query_id), F.col("id").alias(id_col), "dist", F.col("row_number").cast("long").alias("row_number"))
