"""Searches of the index that promise the true neighbours, against DuckDB on rows where a walk alone is not enough."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from nearfield.config import IndexConfig
from nearfield.plans import index, queries
from nearfield.plans.graph import Graph

NAMES = ["index_build_doubling", "index_build_serial", "index_edges_1bit", "index_edges_float16", "index_edges_int8", "index_edges_ternary", "index_joined", "index_nearest", "index_search_filtered", "index_search_many", "index_search_shards"]
#: Those that are held against their SQL over several cells too.
IN_CELLS = ["index_build_serial", "index_edges_float16", "index_edges_int8", "index_edges_ternary"]


@pytest.fixture(scope="module")
def near_ties(tmp_path_factory):
    """400 vectors; 60 of them are, to six digits, at one distance from vec_id 0, and nearer by some 1e-7 the higher their id."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    q = np.zeros(64)
    q[0] = 1
    x[0] = q
    side = rng.normal(size=(4000, 64))
    side[:, 0] = 0
    side /= np.sqrt((side**2).sum(1, keepdims=True))
    c = 0.9 + rng.uniform(-4e-7, 4e-7, (4000, 1))
    tied = (c * q + np.sqrt(1 - c**2) * side).astype(np.float32)
    d = 1 - tied[:, 0].astype(float) / np.sqrt((tied.astype(float) ** 2).sum(1))
    tied, d = tied[np.abs(d - 0.1) < 4e-7], d[np.abs(d - 0.1) < 4e-7]
    pick = np.argsort(-d)[:: len(d) // 60][:60]
    x[1:61] = tied[pick]
    folder = tmp_path_factory.mktemp("ties")
    table = pa.table({"vec_id": pa.array(np.arange(400)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(2 + np.arange(400) % 2, pa.int32())})
    pq.write_table(table, folder / "embeddings.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    """Whether a query's rows are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    rows = con.execute(queries.SQL[name])
    columns = [c[0] for c in rows.description]
    want = sorted(rows.fetchall())
    found = queries.QUERIES[name](spark, folder)
    return sorted(map(tuple, found.select(*columns).collect())) == want


@pytest.mark.parametrize("options", [{"METRIC": "l2"}, {"METRIC": "cosine", "BUILD": "serial"}, {"METRIC": "ip"}, {"METRIC": "cosine", "EDGE_TYPE": "ternary"}])
def test_a_walk_is_completed(options):
    """Evenly spread vectors with copies and a narrow beam: the walk misses neighbours, the check finds them all, ties to the lower row."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32))
    x[600:] = x[:300]
    g = Graph(IndexConfig.from_options({"R": 8, "L_INSERT": 16} | options), np.arange(900), x).build()
    for allowed in (None, rng.random(900) < 0.1, np.zeros(900, bool)):
        walked = [g.search(q, 10, 10, allowed=allowed) for q in x[:100]]
        rows = np.arange(900) if allowed is None else np.flatnonzero(allowed)
        want = []
        for q in x[:100]:
            d = np.round(g.measure(g.prepared(q), rows), 6)
            want.append([(d[i], rows[i]) for i in np.lexsort((rows, d))[:10]])
        got = g.complete(x[:100], walked, 10, 6, allowed)
        assert [[i for _, i in r] for r in got] == [[i for _, i in r] for r in want]
        assert all(abs(a - b) < 2e-6 for r, w in zip(got, want) for (a, _), (b, _) in zip(r, w))
        if allowed is None:
            assert [[i for _, i in r] for r in walked] != [[i for _, i in r] for r in want]


@pytest.mark.parametrize("name", NAMES)
def test_true_neighbours(spark, near_ties, monkeypatch, name):
    monkeypatch.setattr(index, "plan_search", lambda *_: "graph")
    assert same_as_sql(spark, near_ties, name)


@pytest.mark.parametrize("name", IN_CELLS)
def test_true_neighbours_in_cells(spark, near_ties, monkeypatch, name):
    """The same with eight cells, as large tables have several."""
    whole = queries._index
    made = []
    monkeypatch.setattr(queries, "_index", lambda *args, **options: made.append(whole(*args, SHARD_ROWS=50, **options)) or made[-1])
    assert same_as_sql(spark, near_ties, name)
    assert made[0].meta["cells"] == 8
