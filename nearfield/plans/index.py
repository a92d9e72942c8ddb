"""A persisted vector index: proximity graphs in shards around centroids, deltas, tombstones, snapshots.

A bounded sample of the rows gives centroids; every row goes to the cell of its
nearest one, and a cell is one shard or, if it is large, several by a hash of
the id. A shard is one graph, packed into one row of a table that has a folder
for each cell. A query asks the shards of its nearest cells alone, as many as
held nearly all near rows of the sample: their rows are read, each by itself,
and nothing of the index is shuffled. Inserts and
deletes append small tables; compaction writes new shards for the cells they
touch. Each change is a new numbered state of the index, put in place only if
no other writer took that number; older states can be opened until a vacuum.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IndexConfig, Metric
from ..functions.distance import distance
from ..operators.blocks import BROADCAST_BYTES, matrix, many_nearest
from ..operators.knn import ROUND, check_k
from ..sources.store import Store
from .graph import NONE, Graph

PACKED = "shard int, n long, edges long, ids binary, vectors binary, near binary, dist binary, entry int, cell int"
NODE = "shard int, node_id long, vector array<float>, neighbor_ids array<long>, neighbor_dists array<float>"
VECTOR = "node_id long, vector array<float>"
DELTA = f"{VECTOR}, version long"
TOMBSTONE = "node_id long, version long"
EF_SEARCH = "nearfield.efSearch"
#: Most cells; centroids are fitted on at most SAMPLE rows for each cell. A shard's graph has at most SHARD_BYTES.
MOST_CELLS, SAMPLE, ROUNDS = 4096, 64, 8
#: Share of a row's near rows that the cells asked by default hold.
COVERED = 0.97
SHARD_BYTES = 64 << 20
#: Most ids (allowed, or changed since the last compaction) that go to all executors; with more the search is exact.
MOST_IDS = 1 << 22
#: Queries that one task takes of those that ask one cell, where they are too many to go to all executors.
QUERIES_AT_ONCE = 4096


def element_type(df: DataFrame, col: str) -> str:
    kind = df.schema[col].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{col} is no array column")
    if isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return "float32"
    if isinstance(kind.elementType, T.ByteType):
        return "int8"
    raise ValueError("vectors must be arrays of float, double or tinyint")


# --- cells


def directed(x: np.ndarray, config: IndexConfig) -> np.ndarray:
    """Vectors as cells see them: of length one, unless distances are Euclidean."""
    if config.metric is Metric.L2:
        return x
    norms = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(norms == 0, 1, norms)


def nearest_cells(x: np.ndarray, centroids: np.ndarray, most: int = 1) -> np.ndarray:
    """Numbers of the `most` nearest centroids of each row, nearest first, ties to the lower number."""
    d = (centroids**2).sum(1)[None] - 2 * (x @ centroids.T)
    if most == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :most]


def centroids_of(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spread rows; an empty cell keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([nearest_cells(x[a : a + 8192], centroids)[:, 0] for a in range(0, len(x), 8192)])
        count = np.bincount(own, minlength=cells)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.searchsorted(own[order], np.flatnonzero(count)), axis=0)
        centroids[count > 0] = sums / count[count > 0][:, None]
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, asked: int = 256, k: int = 10, share: float = COVERED) -> int:
    """How many cells, nearest first, hold the given share of the k nearest sample rows of evenly spread sample rows.

    The sample is thinner than the table, so its near rows lie further off and
    take rather more cells than the table's.
    """
    cells = len(centroids)
    own = np.concatenate([nearest_cells(x[a : a + 8192], centroids)[:, 0] for a in range(0, len(x), 8192)])
    k = min(k, len(x) - 1)
    if cells < 2 or k < 1:
        return 1
    square = (x**2).sum(1)
    ranks = []
    for i in np.unique(np.linspace(0, len(x) - 1, asked).astype(int)).tolist():
        d = square - 2 * (x @ x[i])
        d[i] = np.inf
        place = np.empty(cells, np.int64)
        place[nearest_cells(x[i : i + 1], centroids, cells)[0]] = np.arange(cells)
        ranks.append(place[own[np.argpartition(d, k - 1)[:k]]])
    return int(np.quantile(np.concatenate(ranks), share, method="higher")) + 1


def fitted_cells(rows: DataFrame, cells: int, config: IndexConfig) -> tuple[np.ndarray, int]:
    """Centroids from the SAMPLE * cells rows whose ids' hashes are smallest, and how many of them a query needs."""
    chosen = rows.orderBy(F.xxhash64("node_id"), "node_id").limit(SAMPLE * cells).toArrow()
    x = directed(matrix(chosen.column("vector")), config)
    centroids = centroids_of(x, min(cells, len(x)))
    return centroids, probes_for(x, centroids)


# --- shards as rows


def packed(g: Graph, shard: int, cell: int) -> pa.Table:
    columns = [shard, len(g.ids), int(g.count.sum()), g.ids.astype("<i8").tobytes(), g.x.astype("<f4").tobytes(), g.near.astype("<i4").tobytes(), g.dist.astype("<f4").tobytes(), g.entry, cell]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    return pa.table([pa.array([v], k) for v, k in zip(columns, kinds)], [f.split()[0] for f in PACKED.split(", ")])


def unpacked(config: IndexConfig, row: dict) -> Graph:
    ids = np.frombuffer(row["ids"], "<i8")
    g = Graph(config, ids, np.frombuffer(row["vectors"], "<f4").reshape(len(ids), -1))
    g.near = np.frombuffer(row["near"], "<i4").reshape(len(ids), -1).copy()
    g.dist = np.frombuffer(row["dist"], "<f4").reshape(len(ids), -1).astype(float)
    g.count, g.entry = (g.near != NONE).sum(1).astype(np.int32), row["entry"]
    return g


def unpack_rows(config: IndexConfig):
    """mapInArrow body: packed shards to a row for each node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = unpacked(config, row)
                held = g.near != NONE
                ends = np.append(0, np.cumsum(g.count)).astype(np.int32)
                flat = g.x.astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(g.ids), row["shard"], np.int32)),
                        pa.array(g.ids),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(g.ids) + 1, dtype=np.int32) * g.x.shape[1]), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(g.ids[g.near[held]])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(g.dist[held].astype(np.float32))),
                    ],
                    [f.split()[0] for f in NODE.split(", ")],
                )

    return run


def _build(config: IndexConfig):
    def build(group: pa.Table) -> pa.Table:
        g = Graph(config, group.column("node_id").to_numpy(), matrix(group.column("vector"))).build()
        return packed(g, group.column("shard")[0].as_py(), group.column("cell")[0].as_py())

    return build


class VectorIndex:
    """Handle of an index at a path; create or open it, at its newest state or (to read it) at an older one."""

    def __init__(self, spark: SparkSession, path: str, snapshot: int | None = None):
        self.spark, self.store, self.snapshot = spark, Store(spark, path), snapshot
        if not self.store.states():
            raise ValueError(f"no index at {path}")
        if snapshot is not None and snapshot not in self.store.states():
            raise ValueError(f"no state {snapshot} of the index at {path}")

    # --- lifecycle

    @classmethod
    def create(cls, df: DataFrame, col: str, path: str, id_col: str = "vec_id", options: Mapping[str, object] | None = None, name: str = "index", table: str = "", unique: bool = False) -> VectorIndex:
        """Builds the graph of every shard and writes state 1; null vectors are not indexed, repeated ids are refused."""
        if unique:
            raise ValueError("a vector index cannot be unique")
        spark = df.sparkSession
        store = Store(spark, path)
        if store.states():
            raise ValueError(f"there is an index at {path}")
        element = element_type(df, col)
        rows = df.where(F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("node_id"), F.col(col).cast("array<float>").alias("vector"))
        count, least, most = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if count and least != most:
            raise ValueError("vectors of different dimensions")
        if not rows.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1 or node_id is null").isEmpty():
            raise ValueError(f"{id_col} must be unique and not null")
        config = IndexConfig.from_options(options)
        if count:
            config = config.bound(int(most), element)
        meta = {"name": name, "table": table, "id": id_col, "column": col, "version": 1, "deltas": [], "tombstones": [], "clock": 0, "streams": {}, "created": time.time()}
        if not store.commit(1, meta | cls._written(store, rows, count, config)):
            raise ValueError(f"there is an index at {path}")
        return cls(spark, path)

    @classmethod
    def _written(cls, store: Store, rows: DataFrame, count: int, config: IndexConfig) -> dict:
        """Writes all shards of rows with new centroids; what the state then says of them."""
        wanted = min(MOST_CELLS, max(1, -(-count // cls._shard_rows(config))))
        spark = rows.sparkSession
        centroids, probes = fitted_cells(rows, wanted, config) if count else (np.zeros((1, 1)), 1)
        tag = uuid.uuid4().hex
        store.write(f"centroids-{tag}", spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>"))
        pieces = cls._write_shards(store, f"nodes-{tag}", cls._dealt(rows, centroids, config), config, 0)
        meta = {"config": config.to_dict(), "centroids": f"centroids-{tag}", "cells": len(centroids), "probes": probes, "nodes": [f"nodes-{tag}"], "pieces": pieces}
        return meta | {"parts": dict.fromkeys(pieces, f"nodes-{tag}"), "shards": sum(pieces.values()), "numbered": sum(pieces.values())}

    @staticmethod
    def _shard_rows(config: IndexConfig) -> int:
        """Rows of a shard: as the option says, and no more than SHARD_BYTES of vectors and edges."""
        return max(1, min(config.shard_rows, SHARD_BYTES // max(1, 4 * config.dimensions + 8 * config.r)))

    @staticmethod
    def _dealt(rows: DataFrame, centroids: np.ndarray, config: IndexConfig) -> DataFrame:
        """rows with their cells; centroids are at most MOST_CELLS."""
        if len(centroids) == 1:
            return rows.select("node_id", "vector", F.lit(0).alias("cell"))
        sent = rows.sparkSession.sparkContext.broadcast(centroids)

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = directed(matrix(batch.column(1)), config)
                cell = np.concatenate([nearest_cells(x[a : a + 4096], sent.value)[:, 0] for a in range(0, len(x), 4096)] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["node_id", "vector", "cell"])

        return rows.select("node_id", "vector").mapInArrow(deal, f"{VECTOR}, cell int")

    @classmethod
    def _write_shards(cls, store: Store, name: str, dealt: DataFrame, config: IndexConfig, total: int) -> dict[str, int]:
        """Writes the packed shards of rows with cells, numbered from total; how many shards each cell has."""
        size = cls._shard_rows(config)
        counts = dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()  # at most MOST_CELLS rows
        pieces = {r["cell"]: -(-r["n"] // size) for r in counts}
        starts = {}
        for cell in sorted(pieces):
            starts[cell], total = total, total + pieces[cell]
        table = store.spark.createDataFrame([(c, starts[c], pieces[c]) for c in sorted(pieces)], "cell int, first int, pieces int")
        placed = dealt.join(F.broadcast(table), "cell")  # a row for each cell
        placed = placed.select("cell", (F.col("first") + F.pmod(F.xxhash64("node_id"), F.col("pieces"))).cast("int").alias("shard"), "node_id", "vector")
        shards = placed.groupBy("shard").applyInArrow(_build(config), PACKED)
        shards.write.partitionBy("cell").parquet(f"{store.path}/{name}")
        return {str(c): n for c, n in pieces.items()}

    @property
    def meta(self) -> dict:
        return self.store.state(self.snapshot)

    @property
    def config(self) -> IndexConfig:
        return IndexConfig.from_dict(self.meta["config"])

    def snapshots(self) -> list[int]:
        """Numbers of the states that can be opened."""
        return self.store.states()

    def drop(self) -> None:
        self.store.delete()

    def _commit(self, change: Callable[[dict], dict]) -> dict:
        """Puts change(newest state) in place as the next state; anew, if another writer was first."""
        if self.snapshot is not None:
            raise ValueError("an older state can only be read")
        for _ in range(100):
            number = self.store.states()[-1]
            new = change(self.store.state(number))
            if self.store.commit(number + 1, new):
                return new
        raise RuntimeError("too many other writers")

    # --- content

    def shards(self, cells: Sequence[int] | None = None, meta: dict | None = None) -> DataFrame:
        """The packed shards of all cells, or of some: other folders are not read."""
        meta = meta or self.meta
        out = None
        for name in meta["nodes"]:  # as many as compactions since all was rebuilt
            own = [int(c) for c, n in meta["parts"].items() if n == name and (cells is None or int(c) in cells)]
            if not own and out is not None:
                continue
            part = self.spark.read.schema(PACKED).parquet(f"{self.store.path}/{name}").where(F.col("cell").isin(own) if own else F.lit(False))
            out = part if out is None else out.unionByName(part)
        return out

    def nodes(self) -> DataFrame:
        """shard, node_id, vector and neighbours of every node."""
        return self.shards().mapInArrow(unpack_rows(self.config), NODE)

    def _tables(self, names: Sequence[Sequence], schema: str) -> DataFrame:
        """The tables of these names (name, version), read as one; version says which came later."""
        if not names:
            return self.spark.createDataFrame([], schema)
        fields = ", ".join(f for f in schema.split(", ") if not f.startswith("version"))
        paths = [f"{self.store.path}/{name}" for name, _ in names]
        version = F.regexp_extract(F.col("_metadata.file_path"), "/[a-z]+-([0-9]+)-[0-9a-f]+/[^/]*$", 1).cast("long")
        order = self.spark.createDataFrame([(int(name.split("-")[1]), v) for name, v in names], "__name long, version long")
        found = self.spark.read.schema(fields).parquet(*paths).withColumn("__name", version)
        return found.join(F.broadcast(order), "__name").drop("__name")  # a row for each insert since the last compaction

    def delta(self, meta: dict | None = None) -> DataFrame:
        """The newest inserted vector of each id that was not deleted since; of an id's rows in one insert, the greatest vector."""
        meta = meta or self.meta
        newest = Window.partitionBy("node_id").orderBy(F.desc("version"), F.desc("vector"))
        added = self._tables(meta["deltas"], DELTA).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
        gone = self._tables(meta["tombstones"], TOMBSTONE).groupBy("node_id").agg(F.max("version").alias("gone"))
        return added.join(gone, "node_id", "left").where("gone is null or gone < version").select("node_id", "vector", "version")

    def _touched(self, meta: dict | None = None) -> DataFrame:
        """Ids whose base rows are superseded."""
        meta = meta or self.meta
        return self._tables(meta["tombstones"], TOMBSTONE).select("node_id").unionByName(self._tables(meta["deltas"], DELTA).select("node_id")).distinct()

    def rows(self, meta: dict | None = None) -> DataFrame:
        """node_id, vector of everything visible: base without touched ids, and the delta."""
        meta = meta or self.meta
        base = self.shards(meta=meta).mapInArrow(unpack_rows(self.config), NODE).select("node_id", "vector")
        if meta["deltas"] or meta["tombstones"]:
            base = base.join(self._touched(meta), "node_id", "left_anti").unionByName(self.delta(meta).select("node_id", "vector"))
        return base

    # --- changes

    def _append(self, kind: str, df: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Adds a table of changes. Of a stream's batch (its name and number) that was applied before, nothing."""
        if stream and self.meta["streams"].get(stream[0], -1) >= stream[1]:
            return
        name = f"{kind}-{time.time_ns()}-{uuid.uuid4().hex}"
        self.store.write(name, df)

        def change(meta: dict) -> dict:
            clock = meta["clock"] + 1
            streams = meta["streams"] | ({stream[0]: stream[1]} if stream else {})
            return meta | {kind: [*meta[kind], [name, clock]], "clock": clock, "streams": streams}

        self._commit(change)

    def insert(self, df: DataFrame, col: str | None = None, id_col: str | None = None, stream: tuple[str, int] | None = None) -> None:
        """Adds vectors, or replaces those of the same id; null vectors are left out."""
        meta, config = self.meta, self.config
        col, id_col = col or meta["column"], id_col or meta["id"]
        rows = df.where(F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("node_id"), F.col(col).cast("array<float>").alias("vector"))
        if config.dimensions and (wrong := rows.where(F.size("vector") != config.dimensions).limit(1).count()):
            raise ValueError(f"vectors need {config.dimensions} dimensions ({wrong} wrong)")
        self._append("deltas", rows, stream)

    def delete(self, ids: DataFrame | Sequence[int]) -> None:
        """Marks ids deleted; ids that are not there do no harm."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "node_id long")
        self._append("tombstones", ids.select(F.col(ids.columns[0]).cast("long").alias("node_id")))

    def update(self, df: DataFrame, col: str | None = None, id_col: str | None = None) -> None:
        """An insert replaces what was there."""
        self.insert(df, col, id_col)

    def compact(self, rebuild: bool = False) -> None:
        """Folds deltas and tombstones into a new version; only cells with changes are rebuilt, or all with rebuild or if the rows outgrow the cells.

        Changes that other writers append meanwhile stay. If another writer
        compacts first, nothing is done.
        """
        meta, config = self.meta, self.config
        if not (meta["deltas"] or meta["tombstones"] or rebuild):
            return
        rows = self.rows(meta)
        if not config.dimensions and (first := rows.select(F.size("vector")).first()):
            config = config.bound(first[0], "float32")
        count = rows.count()
        needed = min(MOST_CELLS, max(1, -(-count // self._shard_rows(config))))
        if rebuild or needed >= 2 * meta["cells"]:
            new = self._written(self.store, rows, count, config)
        else:
            centroids = self._centroids(meta)
            touched = self._touched(meta)
            base = self.shards(meta=meta).mapInArrow(unpack_cells(config), "node_id long, cell int")
            cells = [r[0] for r in base.join(touched, "node_id", "left_semi").select("cell").unionByName(self._dealt(self.delta(meta), centroids, config).select("cell")).distinct().collect()]  # at most MOST_CELLS
            name = f"nodes-{uuid.uuid4().hex}"
            kept = self.shards(cells, meta).mapInArrow(unpack_rows(config), NODE).select("node_id", "vector").join(touched, "node_id", "left_anti")
            changed = kept.unionByName(self.delta(meta).select("node_id", "vector"))
            pieces = {c: n for c, n in meta["pieces"].items() if int(c) not in cells}
            fresh = self._write_shards(self.store, name, self._dealt(changed, centroids, config), config, meta["numbered"])
            parts = {c: n for c, n in meta["parts"].items() if int(c) not in cells} | {c: name for c in fresh}
            pieces |= fresh
            new = {"config": config.to_dict(), "parts": parts, "pieces": pieces, "shards": max(1, sum(pieces.values())), "nodes": [n for n in meta["nodes"] if n in parts.values()] + [name], "numbered": meta["numbered"] + sum(fresh.values())}
        base = meta["version"]

        def change(now: dict) -> dict:
            if now["version"] != base:
                return now
            later = {k: [x for x in now[k] if x not in meta[k]] for k in ("deltas", "tombstones")}
            return now | new | later | {"version": base + 1}

        self._commit(change)

    def optimize(self) -> None:
        """Rebuilds every shard around new centroids, with as many cells as the rows now need."""
        self.compact(rebuild=True)

    def vacuum(self) -> None:
        """Compacts and deletes older states and the files that the newest does not use."""
        self.compact()
        newest = self.store.states()[-1]
        meta = self.store.state(newest)
        live = {self.store.state_name(newest), meta["centroids"], *meta["nodes"], *(n for n, _ in meta["deltas"] + meta["tombstones"])}
        for name in self.store.names():
            if name not in live:
                self.store.delete(name)

    def merge(self, other: VectorIndex) -> None:
        """Takes over another index's vectors."""
        if other.config.dimensions != self.config.dimensions or other.config.metric is not self.config.metric:
            raise ValueError("indexes of different dimensions or metrics")
        self.insert(other.rows(), "vector", "node_id")
        self.compact()

    # --- search

    def _centroids(self, meta: dict) -> np.ndarray:
        found = self.store.read(meta["centroids"]).orderBy("cell").toArrow()  # at most MOST_CELLS rows
        return matrix(found.column("centroid"))

    def search(self, query: Sequence[float], k: int, ef: int | None = None, allowed: DataFrame | None = None, gamma: float = 1.0, warn: bool = False, probes: int | None = None, complete: bool = False) -> DataFrame:
        """id, dist, row_number of about the k nearest; allowed (ids) are the only results, whatever the walk crosses."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        found = self.search_many(one, k, ef, allowed, gamma, probes=probes, complete=complete).drop("query_id").orderBy("row_number")
        if warn and (n := found.count()) < k:
            warnings.warn(f"the search gave {n} of {k} rows", stacklevel=2)
        return found

    def _ids(self, df: DataFrame | None) -> np.ndarray | None:
        """The distinct ids in order, if they are few enough to be sent to all executors; else None."""
        found = df.select(F.col(df.columns[0]).cast("long").alias("node_id")).where("node_id is not null").distinct()
        found = found.limit(MOST_IDS + 1).toArrow().column("node_id").to_numpy()
        return np.sort(found) if len(found) <= MOST_IDS else None

    def search_many(self, queries: DataFrame, k: int, ef: int | None = None, allowed: DataFrame | None = None, gamma: float = 1.0, stats: bool = False, probes: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, complete: bool = False) -> DataFrame:
        """query_id, id, dist, row_number for a table of queries (query_id, query); each asks the shards of its `probes` nearest cells.

        A query set of checked size goes to all executors, which read the shards
        of the cells that it asks; a larger one meets them by cell, in blocks.
        With allowed ids, all cells are asked. If more than MOST_IDS ids are
        allowed or changed since the last compaction, the search is exact. With
        complete, all cells are asked and each walk is followed by an exact check
        of its shard, so that the results are the true neighbours, ordered by
        rounded distance and id.
        """
        check_k(k)
        config, meta = self.config, self.meta
        breadth = ef or int(self.spark.conf.get(EF_SEARCH, "0")) or config.l_search
        probes = probes or config.probes or meta["probes"]
        if breadth < 1 or probes < 1:
            raise ValueError("ef and probes must be at least 1")
        queries = queries.select(F.col("query_id"), F.col("query").cast("array<double>").alias("query")).where("query is not null")
        size, least, most = queries.agg(F.count("*"), F.min(F.size("query")), F.max(F.size("query"))).first()
        if config.dimensions and size and (least != config.dimensions or most != config.dimensions):
            raise ValueError(f"queries need {config.dimensions} dimensions")
        only = self._ids(allowed) if allowed is not None else None
        gone = self._ids(self._touched(meta)) if meta["deltas"] or meta["tombstones"] else np.zeros(0, np.int64)
        if gone is None or (allowed is not None and only is None):
            rows = self.rows(meta)
            if allowed is not None:
                rows = rows.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("node_id")).distinct(), "node_id", "left_semi")
            exact = many_nearest(rows, queries, k, config.metric, "node_id", "vector")
            return exact.withColumnRenamed("node_id", meta["id"])
        sent = self.spark.sparkContext.broadcast((only, gone))
        kind = queries.schema["query_id"].dataType.simpleString()
        schema = f"query_id {kind}, id long, dist double, visits long"
        cells = meta["cells"]
        probes = cells if allowed is not None or complete else min(probes, cells)

        def asked(row: dict, qids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
            """One shard's answers to some queries."""
            only, gone = sent.value
            g = unpacked(config, row)
            ok = None
            if only is not None or len(gone):
                ok = np.isin(g.ids, only) if only is not None else np.ones(len(g.ids), bool)
                ok &= ~np.isin(g.ids, gone)
            walked, visits = [], []
            for at in range(len(q)):
                g.visits = 0
                walked.append(g.search(q[at], k, breadth, allowed=ok, gamma=gamma))
                visits.append(g.visits)
            if complete:
                walked = g.complete(q, walked, k, ROUND, ok)
            out = [(at, int(g.ids[i]), round(d, ROUND), visits[at]) for at, found in enumerate(walked) for d, i in found]
            columns = list(zip(*out)) if out else [[], [], [], []]
            return pa.RecordBatch.from_arrays([qids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], ["query_id", "id", "dist", "visits"])

        centroids = self._centroids(meta) if cells > 1 else None
        if size * (most or 0) * 8 <= broadcast_bytes:
            held = queries.toArrow()
            qids, q = held.column("query_id").combine_chunks(), matrix(held.column("query"))
            near = nearest_cells(directed(q, config), centroids, probes) if cells > 1 and len(q) else np.zeros((len(q), 1), int)
            wanted = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
            everyone = self.spark.sparkContext.broadcast((qids, q, wanted))

            def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                qids, q, wanted = everyone.value
                for batch in batches:
                    for i in range(batch.num_rows):
                        row = batch.slice(i, 1).to_pylist()[0]
                        own = wanted.get(row["cell"], ())
                        if len(own):
                            yield asked(row, qids.take(pa.array(own)), q[own])

            found = self.shards(list(wanted), meta).mapInArrow(scan, schema)
        else:
            found = self._by_cell(queries, centroids, probes, meta, config, asked, schema, kind)
        if stats:
            return found
        found = found.drop("visits")
        if meta["deltas"]:
            extra = self.delta(meta)
            if allowed is not None:
                extra = extra.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("node_id")).distinct(), "node_id", "left_semi")
            more = many_nearest(extra, queries, k, config.metric, "node_id", "vector", broadcast_bytes=broadcast_bytes)
            found = found.unionByName(more.select("query_id", F.col("node_id").alias("id"), "dist"))
        order = Window.partitionBy("query_id").orderBy("dist", "id")
        return found.withColumn("row_number", F.row_number().over(order)).where(F.col("row_number") <= k).select("query_id", F.col("id").alias(meta["id"]), "dist", F.col("row_number").cast("long").alias("row_number"))

    def _by_cell(self, queries: DataFrame, centroids: np.ndarray | None, probes: int, meta: dict, config: IndexConfig, asked: Callable, schema: str, kind: str) -> DataFrame:
        """Answers to a query set of any size: queries and shards meet by cell, at most about QUERIES_AT_ONCE queries to a task."""
        sent = self.spark.sparkContext.broadcast(centroids)

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                near = nearest_cells(directed(matrix(batch.column(1)), config), sent.value, probes) if sent.value is not None and n else np.zeros((n, 1), int)
                again = pa.array(np.repeat(np.arange(n), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], ["query_id", "query", "cell"])

        dealt = queries.mapInArrow(deal, f"query_id {kind}, query array<double>, cell int")
        counts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("blocks"))  # at most MOST_CELLS rows
        dealt = dealt.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        shards = self.shards(meta=meta).join(F.broadcast(counts), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def meet(rows: pa.Table, some: pa.Table) -> pa.Table:
            out = []
            if rows.num_rows and some.num_rows:
                qids, q = some.column("query_id").combine_chunks(), matrix(some.column("query"))
                out = [asked(rows.slice(i, 1).to_pylist()[0], qids, q) for i in range(rows.num_rows)]
            empty = pa.schema([("query_id", some.column("query_id").type), ("id", pa.int64()), ("dist", pa.float64()), ("visits", pa.int64())])
            return pa.Table.from_batches(out, empty)

        columns = [f.split()[0] for f in PACKED.split(", ")]
        return shards.select(*columns, "block").groupBy("cell", "block").cogroup(dealt.select("query_id", "query", "cell", "block").groupBy("cell", "block")).applyInArrow(meet, schema)

    def exact(self, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The true k nearest of what is visible (and allowed): the yardstick for search."""
        check_k(k)
        rows = self.rows()
        if allowed is not None:
            rows = rows.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("node_id")).distinct(), "node_id", "left_semi")
        near = F.round(distance("vector", list(query), self.config.metric), ROUND)
        return rows.select(F.col("node_id").alias(self.meta["id"]), near.alias("dist")).orderBy("dist", self.meta["id"]).limit(k)

    def nearest(self, query: Sequence[float], k: int, allowed: DataFrame | None = None, **how) -> DataFrame:
        """id, dist of the k nearest: exactly where few rows remain to compare, else by the graphs (plan_search)."""
        share = 1.0
        if allowed is not None:
            rows = max(1, sum(r[0] for r in self.shards().select("n").collect()))
            share = min(1.0, allowed.count() / rows)
        if plan_search(self, query, k, share) == "exact":
            return self.exact(query, k, allowed)
        return self.search(query, k, allowed=allowed, **how).select(self.meta["id"], "dist")

    def join(self, outer: DataFrame, base: DataFrame, outer_col: str, k: int, outer_id: str = "query_id", **how) -> DataFrame:
        """For each outer row the base rows of its k nearest in the index: base columns, row_number, dist, outer columns."""
        from ..operators.joins import with_columns

        found = self.search_many(outer.select(F.col(outer_id).alias("query_id"), F.col(outer_col).alias("query")), k, **how)
        return with_columns(found, outer, base, outer_id, self.meta["id"])

    def fetch(self, found: DataFrame, base: DataFrame) -> DataFrame:
        """The base rows of a result, with dist and row_number; a result is small, so Spark may send it to the base."""
        return base.join(found, self.meta["id"])

    # --- inspection

    def info(self) -> DataFrame:
        """One row: names, metric, sizes, and node and edge counts per level (a graph has one). Only counts are read."""
        meta, config = self.meta, self.config
        sums = self.shards(meta=meta).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
        level = F.struct(F.col("nodes").alias("nodes"), F.col("edges").alias("edges"), (F.col("nodes") * config.r).alias("max_edges"), (F.col("nodes") * config.node_bytes()).alias("allocated_bytes"))
        return sums.select(
            F.lit("spark").alias("catalog_name"),
            F.lit("default").alias("schema_name"),
            F.lit(meta["name"]).alias("index_name"),
            F.lit(meta["table"]).alias("table_name"),
            F.lit(config.metric.value).alias("metric"),
            F.lit(config.dimensions).cast("long").alias("dimensions"),
            F.col("nodes").alias("count"),
            F.lit(max(1, meta["shards"]) * self._shard_rows(config)).cast("long").alias("capacity"),
            (F.col("nodes") * config.node_bytes()).alias("approx_memory_usage"),
            F.lit(1).cast("long").alias("levels"),
            F.array(level).alias("levels_stats"),
        )

    def verify(self) -> DataFrame:
        """Broken invariants by shard; all counts are 0 in a sound index."""
        config = self.config
        names = ["over_degree", "self_edges", "repeated_edges", "dangling_edges", "unreachable"]

        def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = unpacked(config, row).faults()
                    yield pa.RecordBatch.from_pandas(pd.DataFrame([{"shard": np.int32(row["shard"]), "nodes": row["n"]} | {n: found[n] for n in names}]), preserve_index=False)

        return self.shards().mapInArrow(check, "shard int, nodes long, " + ", ".join(f"{n} long" for n in names))

    def __str__(self) -> str:
        meta, config = self.meta, self.config
        return f"index {meta['name']} (version {meta['version']}): {config.metric.value}, {config.dimensions} dimensions, r {config.r}, {meta['shards']} shards, {len(meta['deltas'])} deltas, {len(meta['tombstones'])} tombstone tables"


def unpack_cells(config: IndexConfig):
    """mapInArrow body: packed shards to the ids of their nodes with the shard's cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["cell"], np.int32))], ["node_id", "cell"])

    return run


def plan_search(index: VectorIndex, query: Sequence[float], k: int, allowed_share: float = 1.0, exact_below: int = 10_000, exact_share: float = 0.02) -> str:
    """'exact' where few rows remain to compare (small tables, narrow filters), else 'graph'."""
    rows = (index.shards().agg(F.sum("n")).first()[0] or 0) * allowed_share
    return "exact" if rows <= max(exact_below, k) or allowed_share <= exact_share else "graph"
