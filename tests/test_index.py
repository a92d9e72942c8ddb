import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.config import IndexConfig
from nearfield.functions import sql
from nearfield.operators import joins
from nearfield.plans.graph import Graph
from nearfield.plans.index import VectorIndex, plan_search
from nearfield.streaming.ingest import ingest


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(10, d))[rng.integers(0, 10, n)] + 0.3 * rng.normal(size=(n, d))


@pytest.mark.parametrize(
    "options",
    [{"METRIC": "l2"}, {"METRIC": "cosine"}, {"METRIC": "ip"}, {"METRIC": "cosine", "EDGE_TYPE": "ternary"}, {"METRIC": "cosine", "EDGE_TYPE": "1bit"}, {"METRIC": "l2", "EDGE_TYPE": "int8"}, {"METRIC": "ip", "EDGE_TYPE": "float16"}, {"METRIC": "l2", "BUILD": "doubling"}, {"METRIC": "cosine", "BUILD": "serial"}],
)
def test_graph_kernel(options):
    x = clustered(600, 24)
    g = Graph(IndexConfig.from_options({"R": 16, "L_INSERT": 48} | options), np.arange(600)[::-1].copy(), x).build()
    assert not any(g.faults().values())
    again = Graph(g.config, np.arange(600)[::-1].copy(), x).build()
    assert (again.near == g.near).all()
    hit = 0
    for q in x[:40]:
        d = g.measure(g.prepared(q), np.arange(600))
        truth = set(np.lexsort((np.arange(600), d))[:10].tolist())
        hit += len(truth & {r for _, r in g.search(q, 10, 100)})
    assert hit / 400 >= 0.95


@pytest.mark.parametrize("clusters", [10, 50])
def test_a_shard_of_default_size(clusters):
    """20,000 vectors in tight clusters, all other options at their defaults: recall of 10 over every 500th."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 20_000)] + 0.3 * rng.normal(size=(20_000, 32))
    g = Graph(IndexConfig.from_options({"METRIC": "cosine"}), np.arange(20_000), x).build()
    assert not any(g.faults().values())
    hit = 0
    for q in x[::500]:
        truth = set(np.lexsort((np.arange(len(x)), g.measure(g.prepared(q), np.arange(len(x)))))[:10].tolist())
        hit += len(truth & {r for _, r in g.search(q, 10, 100)})
    assert hit / 400 >= 0.95


def test_pruning_against_the_rule():
    """A candidate is kept unless a kept one, alpha times, is nearer to it than the node is; then the nearest fill up."""
    x = clustered(80, 6, 7)
    g = Graph(IndexConfig.from_options({"R": 8, "L_INSERT": 30}), np.arange(80), x)
    near, dist = g._nearest(np.arange(80), np.arange(80), 30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(dist, np.sort(d, axis=1)[:, 1:31])
    kept = g._pruned(np.arange(80), near, dist, 8)
    for node in range(80):
        chosen = []
        for c in near[node].tolist():
            if len(chosen) < 8 and not any(1.2 * d[c, o] < d[node, c] for o in chosen):
                chosen.append(c)
        more = [c for c in near[node].tolist() if c not in chosen][: max(0, 4 - len(chosen))]
        assert set(near[node][kept[node]].tolist()) == set(chosen + more)


def test_filtered_walk_gives_only_allowed():
    x = clustered(500, 16, 3)
    g = Graph(IndexConfig.from_options({"R": 16, "L_INSERT": 48}), np.arange(500), x).build()
    for share in (0.0, 0.002, 0.5, 1.0):
        allowed = np.zeros(500, bool)
        allowed[: int(500 * share)] = True
        found = g.search(x[0], 5, 500, allowed=allowed)
        assert len(found) == min(5, int(500 * share)) and all(allowed[r] for _, r in found)


def test_small_and_duplicate_graphs():
    c = IndexConfig.from_options({"R": 4, "L_INSERT": 8})
    assert Graph(c, np.array([], np.int64), np.zeros((0, 3))).build().search(np.zeros(3), 5, 10) == []
    assert Graph(c, np.array([7]), np.ones((1, 3))).build().search(np.zeros(3), 5, 10)[0][1] == 0
    g = Graph(c, np.arange(60), np.ones((60, 3))).build()
    assert not any(g.faults().values()) and len(g.search(np.ones(3), 5, 60)) == 5
    for build in ("doubling", "serial"):
        g = Graph(IndexConfig.from_options({"R": 4, "L_INSERT": 8, "BUILD": build}), np.arange(600), np.repeat(clustered(300, 4), 2, axis=0)).build()
        assert not any(g.faults().values())


@pytest.fixture()
def index(spark, sf, tmp_path):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 200")
    return VectorIndex.create(base, "embedding", f"file://{tmp_path}/ix", options={"METRIC": "cosine", "R": 16, "L_INSERT": 40, "SHARD_ROWS": 80}, name="v", table="embeddings")


def test_lifecycle(spark, sf, index):
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = [float(x) for x in base.where("vec_id = 0").first()["embedding"]]
    found = index.search(q, 5).collect()
    assert [r["row_number"] for r in found] == [1, 2, 3, 4, 5] and found[0]["vec_id"] == 0
    assert index.meta["cells"] == 3 and index.meta["shards"] >= 3 and index.info().first()["count"] == 200
    assert not any(sum(r[2:]) for r in index.verify().collect())
    # delete, also of shard entries; insert and insert again
    index.delete([0, 1, 2, 12345])
    assert 0 not in {r["vec_id"] for r in index.search(q, 5).collect()}
    index.insert(base.where("vec_id in (0, 250)"))
    assert index.search(q, 1).first()["vec_id"] == 0
    assert index.rows().count() == 199
    exact = [tuple(r) for r in index.exact(q, 5).collect()]
    index.compact()
    assert index.meta["version"] == 2 and index.nodes().count() == 199
    assert [tuple(r) for r in index.exact(q, 5).collect()] == exact
    assert not any(sum(r[2:]) for r in index.verify().collect())
    # update replaces; deleting it later wins; a filter restricts
    index.update(base.where("vec_id = 250").withColumn("embedding", F.array(*(F.lit(x) for x in q)).cast("array<float>")))
    assert {r["vec_id"] for r in index.search(q, 2).collect()} == {0, 250}
    index.delete([250])
    assert index.rows().where("node_id = 250").count() == 0
    only = spark.createDataFrame([(5,), (6,)], "id long")
    assert {r["vec_id"] for r in index.search(q, 5, allowed=only).collect()} == {5, 6}
    index.vacuum()
    meta = index.meta
    assert sorted(index.store.names()) == sorted([index.store.state_name(index.snapshots()[0]), meta["centroids"], *meta["nodes"]]) and len(index.snapshots()) == 1
    index.optimize()
    assert index.nodes().count() == 198
    assert "cosine" in str(index) and plan_search(index, q, 5) == "exact"
    assert [r["vec_id"] for r in index.nearest(q, 3).collect()] == [r["vec_id"] for r in index.exact(q, 3).collect()]
    index.drop()
    with pytest.raises(ValueError):
        VectorIndex(spark, index.store.path)


def test_merge_and_fetch(spark, sf, index, tmp_path):
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    other = VectorIndex.create(base.where("vec_id between 200 and 260"), "embedding", f"file://{tmp_path}/other", options={"METRIC": "cosine", "R": 16, "L_INSERT": 40})
    index.merge(other)
    assert index.nodes().count() == 261
    q = [float(x) for x in base.where("vec_id = 230").first()["embedding"]]
    assert index.fetch(index.search(q, 1), base).first()["vec_id"] == 230
    with pytest.warns(UserWarning):
        index.search(q, 400, warn=True)


def test_creation_errors(spark, tmp_path):
    make = lambda rows, kind, **more: VectorIndex.create(spark.createDataFrame(rows, f"vec_id long, v {kind}"), "v", f"file://{tmp_path}/e{len(list(tmp_path.iterdir()))}", **more)
    with pytest.raises(ValueError):
        make([(1, "a")], "string")
    with pytest.raises(ValueError):
        make([(1, ["a"])], "array<string>")
    with pytest.raises(ValueError):
        make([(1, [1.0]), (2, [1.0, 2.0])], "array<float>")
    with pytest.raises(ValueError):
        make([(1, [])], "array<float>")
    with pytest.raises(ValueError):
        make([(1, [1.0])], "array<float>", unique=True)
    with pytest.raises(ValueError):
        make([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "array<float>")
    small = make([(1, [1, 2]), (2, None), (3, [-3, 4])], "array<tinyint>", options={"R": 4, "L_INSERT": 4})
    assert small.config.element_type == "int8" and small.nodes().count() == 2
    with pytest.raises(ValueError):
        small.search([1.0, 2.0, 3.0], 1)
    with pytest.raises(ValueError):
        small.search([1.0, 2.0], 0)
    with pytest.raises(ValueError):
        small.insert(spark.createDataFrame([(9, [1.0])], "vec_id long, v array<float>"))


def test_stream(spark, sf, tmp_path):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").limit(60)
    index = VectorIndex.create(base.limit(0), "embedding", f"file://{tmp_path}/ix", options={"R": 8, "L_INSERT": 16})
    rows = base.select("vec_id", "embedding", F.when(F.col("vec_id") % 10 == 3, "delete").otherwise("put").alias("op"))
    rows.where("op = 'put'").unionByName(rows.where("op = 'delete'")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest(stream, index, f"{tmp_path}/state", op_col="op", compact_every=1).awaitTermination()
    assert index.rows().count() == rows.where("op = 'put'").count() and index.meta["deltas"] == []


def test_ternary_recall_with_default_options(spark, sf):
    from nearfield.plans.queries import QUERIES

    found = QUERIES["index_recall_ternary"](spark, sf).first()
    assert found["queries"] == 5 and found["recall"] >= 0.9


def test_compaction_adds_shards(spark, sf, tmp_path):
    """An index created empty gets as many shards as its rows need, and no shard holds them all."""
    base = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 60")
    index = VectorIndex.create(base.limit(0), "embedding", f"file://{tmp_path}/grown", options={"R": 8, "L_INSERT": 16, "SHARD_ROWS": 20})
    index.insert(base)
    index.compact()
    assert index.meta["cells"] == 3 and index.nodes().select("shard").distinct().count() == index.meta["shards"] >= 3
    assert index.nodes().groupBy("shard").count().agg(F.max("count")).first()[0] <= 30
    assert index.rows().count() == 60


def truth_of(spark, base, asked, k):
    return joins.lateral_join(asked, base, "query", "embedding", k, "cosine")


def test_a_search_reads_its_cells_alone(spark, sf, tmp_path):
    """Many shards, few probes: nothing of the index is shuffled, other cells are not read, and recall holds on clustered vectors."""
    x = clustered(3000, 16, 5)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = VectorIndex.create(base, "embedding", f"file://{tmp_path}/cells", options={"METRIC": "cosine", "R": 16, "L_INSERT": 40, "SHARD_ROWS": 100})
    assert index.meta["cells"] == 30
    asked = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = index.search_many(asked, 10)
    plan = found._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    below = physical[physical.index("MapInArrow") :]
    assert "Exchange" not in below and "PartitionFilters: [cell" in below
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    want = {(r["query_id"], r["vec_id"]) for r in truth_of(spark, base, asked, 10).collect()}
    assert len(got & want) / len(want) >= 0.95
    # a query set too large to be sent meets the shards by cell, with the same answers
    by_cell = {(r["query_id"], r["vec_id"]) for r in index.search_many(asked, 10, broadcast_bytes=0).collect()}
    assert by_cell == got
    few = index.search_many(asked, 10, probes=1).collect()
    assert 0 < len({(r["query_id"], r["vec_id"]) for r in few} & want) <= len(got & want)


@pytest.mark.parametrize("tight", [True, False])
def test_probes_follow_the_data(spark, tmp_path, tight):
    """Clustered vectors need few cells, evenly spread ones many; recall holds for both."""
    rng = np.random.default_rng(9)
    x = clustered(2000, 32, 4) if tight else rng.normal(size=(2000, 32))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = VectorIndex.create(base, "embedding", f"file://{tmp_path}/p", options={"METRIC": "cosine", "R": 16, "L_INSERT": 40, "SHARD_ROWS": 100})
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["vec_id"]) for r in index.search_many(asked, 10).collect()}
    want = {(r["query_id"], r["vec_id"]) for r in truth_of(spark, base, asked, 10).collect()}
    assert len(got & want) / len(want) >= 0.9
    assert index.meta["probes"] < index.meta["cells"] == 20 and (index.meta["probes"] <= 8) == tight


def test_join_by_the_index_and_from_sql(spark, sf, index):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 200")
    outer = base.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    got, want = index.join(outer, base, "query", 3, ef=200), joins.index_join(outer, base, "query", "embedding", 3, "cosine")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sql.register(spark, indexes={"v": index.store.path})
    assert spark.sql("SELECT count FROM index_info_v").first()["count"] == spark.sql("SELECT count(*) AS n FROM index_rows_v").first()["n"] == 200
    base.createOrReplaceTempView("vectors")
    found = sql.run(spark, "SELECT t.id, b.label, t.row_number FROM (SELECT vec_id AS id, row_number FROM vector_top_k('v', (SELECT embedding FROM vectors WHERE vec_id = 7), 4, 200)) t JOIN vectors b ON b.vec_id = t.id ORDER BY t.row_number").collect()
    q = [float(x) for x in base.where("vec_id = 7").first()["embedding"]]
    assert [r["id"] for r in found] == [r["vec_id"] for r in index.exact(q, 4).collect()]
    assert sql.run(spark, "SELECT count FROM index_info('v')").first()["count"] == 200
    with pytest.raises(ValueError):
        sql.run(spark, "SELECT * FROM vector_top_k('v', array(1.0)")


def test_older_states_and_two_writers(spark, sf, index):
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    before = index.snapshots()[-1]
    index.delete([1, 2, 3])
    other = VectorIndex(spark, index.store.path)
    other.insert(base.where("vec_id = 300"))
    assert index.rows().count() == 198
    old = VectorIndex(spark, index.store.path, snapshot=before)
    assert old.rows().count() == 200
    with pytest.raises(ValueError):
        old.delete([5])
    # a writer that took a state's number first is not overwritten
    number = index.store.states()[-1]
    assert not index.store.commit(number, {"lost": True}) and "lost" not in index.meta
    # changes that come while another writer compacts stay
    real = VectorIndex._write_shards

    def slow(*a):
        other.insert(base.where("vec_id = 301"))
        return real(*a)

    VectorIndex._write_shards = staticmethod(slow)
    try:
        index.compact()
    finally:
        VectorIndex._write_shards = real
    assert index.rows().count() == 199 and len(index.meta["deltas"]) == 1
    index.compact()
    assert index.rows().count() == 199 and index.meta["deltas"] == []
    # a stream's batch that comes twice counts once
    index.insert(base.where("vec_id = 400"), stream=("s", 0))
    index.insert(base.where("vec_id = 401"), stream=("s", 0))
    assert index.rows().where("node_id in (400, 401)").count() == 1
    # of rows of one id in one insert, the greatest vector
    index.insert(spark.createDataFrame([(500, [0.0] * 64), (500, [1.0] * 64)], "vec_id long, embedding array<float>"))
    assert index.rows().where("node_id = 500").first()["vector"][0] == 1.0


def test_the_persistence_setting_is_accepted(spark):
    spark.sql("SET hnsw_enable_experimental_persistence = true")
    spark.conf.unset("hnsw_enable_experimental_persistence")
