import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import pq
from nearfield.operators import aggregates, blocks, fusion, joins, knn, twostage


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, [float(x), float(y), float(z)], i % 7) for i, (x, y, z) in enumerate(np.ndindex(9, 9, 9))]
    return spark.createDataFrame(rows + [(9999, None, 0)], "vec_id long, embedding array<float>, label int")


def brute(q, k, rows):
    d = sorted((round(float(np.linalg.norm(np.array(v) - q)), 6), i) for i, v, _ in rows if v is not None)
    return [(i, x) for x, i in d[:k]]


def test_ties_go_to_the_lower_id(base):
    rows = base.collect()
    q = np.array([4.0, 4.0, 4.0])
    got = [(r["vec_id"], r["dist"]) for r in knn.knn(base, "embedding", q.tolist(), 20).collect()]
    assert got == brute(q, 20, rows)
    assert knn.knn(base, "embedding", [0, 0, 0], 5000).count() == 729
    assert knn.knn(base.limit(0), "embedding", [0, 0, 0], 5).count() == 0


def test_arguments(base):
    for k in (0, -1, True, 2.5):
        with pytest.raises(ValueError):
            knn.knn(base, "embedding", [0, 0, 0], k)
    with pytest.raises(ValueError):
        knn.knn(base, "embedding", [0, 0, 0], 5, filter_mode="both")
    with pytest.raises(ValueError):
        knn.knn(base, "embedding", [0, 0, 0], 5, overfetch=0.5)


def test_filters(base):
    q = [4.0, 4.0, 4.0]
    pre = knn.knn(base, "embedding", q, 5, where="label = 3")
    assert pre.count() == 5 and {r["label"] for r in pre.collect()} == {3}
    assert knn.knn(base, "embedding", q, 5, where="label = 3", filter_mode="post").count() < 5
    over = knn.knn(base, "embedding", q, 5, where="label = 3", filter_mode="post", overfetch=100)
    assert [r["vec_id"] for r in over.collect()] == [r["vec_id"] for r in pre.collect()]
    with pytest.warns(UserWarning, match="0 of 5"):
        knn.knn(base, "embedding", q, 5, where="label = 99", warn=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        knn.knn(base, "embedding", q, 5, warn=True)
    ids = base.where("vec_id < 3").select("vec_id")
    assert {r["vec_id"] for r in knn.knn(base, "embedding", q, 5, allowed=ids).collect()} == {0, 1, 2}
    assert {r["dist"] for r in knn.radius(base, "embedding", q, 1.0).collect()} == {0.0}


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_blocks_agree_with_broadcast_and_with_single_queries(spark, base, metric):
    queries = base.where("vec_id % 97 = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    a = blocks.many_nearest(base, queries, 4, metric)
    b = blocks.many_nearest(base, queries, 4, metric, broadcast_bytes=0)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(a) == rows(b)
    q = queries.orderBy("query_id").first()
    one = [(r["vec_id"], r["dist"]) for r in knn.knn(base, "embedding", [float(x) for x in q["query"]], 4, metric).collect()]
    assert [(r["vec_id"], r["dist"]) for r in a.where(F.col("query_id") == q["query_id"]).orderBy("row_number").collect()] == one
    assert blocks.many_nearest(base, queries.limit(0), 4, metric).count() == 0
    assert blocks.many_nearest(base.limit(0), queries, 4, metric).count() == 0


def test_joins(base):
    left = base.where("vec_id in (0, 364, 9999)")
    got = joins.knn_join(left, base, "embedding", "embedding", 3)
    assert got.columns == ["score", "left_tbl", "right_tbl"] and got.count() == 6
    with pytest.raises(ValueError, match="Unknown metric"):
        joins.knn_join(left, base, "embedding", "embedding", 3, "manhattan")
    match = {r["vec_id"]: r["matches"] for r in joins.knn_match(left, base.withColumn("score", F.lit(1)), "embedding", "embedding", 3).collect()}
    assert [m["score"] for m in match[364]] == [0.0, 1.0, 1.0] and match[9999] == []
    assert "score" not in match[364][0]["row"].asDict()
    by_cosine = joins.knn_join(left, base, "embedding", "embedding", 3, "cos").where("left_tbl.vec_id = 364").collect()
    assert all(r["score"] == 1.0 for r in by_cosine)  # a similarity: the higher the better


def test_min_by_k(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, None), ("b", 4, 2.0), ("a", 5, 1.0)], "g string, x int, v double")
    got = {r["g"]: r["best"] for r in aggregates.min_by_k(df, "x", "v", 2, ["g"]).collect()}
    assert got == {"a": [2, 5], "b": [4]}
    assert aggregates.max_by_k(df, "x", "v", 3).first()[0] == [1, 4, 2]
    assert aggregates.min_by_k(df, "x", "v", 2, where=F.col("g") == "b").first()[0] == [4]
    with pytest.raises(ValueError):
        aggregates.min_by_k(df, "x", "v", 0)


def test_two_stage_is_exact_when_broad(base):
    df = base.withColumn("embedding", F.transform("embedding", lambda x: x - 4)).where("embedding[0] != 0 or embedding[1] != 0 or embedding[2] != 0")
    q = [1.0, 2.0, -3.0]
    exact = [r["vec_id"] for r in knn.knn(df, "embedding", q, 10, "cosine").collect()]
    assert [r["vec_id"] for r in twostage.two_stage(df, "embedding", q, 10, 1000).collect()] == exact
    with pytest.raises(ValueError):
        twostage.two_stage(df, "embedding", q, 10, 100, "l2")


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, d double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "id long, s double")
    got = fusion.fused([a, b], "id", ["d", "s"], 3).collect()
    assert [r["id"] for r in got] == [2, 1, 3] and got[0]["rrf"] == round(1 / 62 + 1 / 61, 9)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_product_codes(spark, sf, metric):
    """Codes against a plain search of the centroids, table sums against decoded vectors, and recall of two stages."""
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = pq.fit(base, "embedding", 8, metric, sample=100)
    x = np.array([r["embedding"] for r in base.orderBy("vec_id").collect()], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    got = {r["vec_id"]: bytes(r["code"]) for r in pq.encoded(base, "embedding", books).collect()}
    for i in range(0, len(x), 25):
        parts = unit[i].reshape(8, 8)
        assert list(got[i]) == [int(((books.centroids[g] - parts[g]) ** 2).sum(1).argmin()) for g in range(8)]
    query = x[3].tolist()
    score = {r["vec_id"]: r["score"] for r in pq.scored(pq.encoded(base, "embedding", books), books, np.array(query)).collect()}
    for i in range(0, len(x), 40):
        decoded = np.concatenate([books.centroids[g][c] for g, c in enumerate(got[i])])
        want = ((decoded - unit[3]) ** 2).sum() if metric == "l2" else -decoded @ unit[3]
        assert np.isclose(score[i], want, atol=1e-5)
    found = [r["vec_id"] for r in twostage.pq_two_stage(base, "embedding", query, 10, 100, metric, groups=16).collect()]
    true = [r["vec_id"] for r in knn.knn(base, "embedding", query, 10, metric).collect()]
    assert len(set(found) & set(true)) >= 9
    with pytest.raises(ValueError):
        pq.fit(base, "embedding", 7)


def test_min_by_post_filter(spark):
    rows = spark.createDataFrame([(g, i, float(i % 7)) for g in "ab" for i in range(20)], "g string, a long, v double")
    got = {r["g"]: r["best"] for r in aggregates.min_by_k(rows, "a", "v", 4, ["g"], where=F.col("a") > 5, filter_mode="post").collect()}
    assert got == {"a": [7, 14], "b": [7, 14]}
    assert aggregates.min_by_k(rows, "a", "v", 4, where=F.col("a") > 5, filter_mode="post").first()["best"] == [7, 7][:2]
    with pytest.raises(ValueError):
        aggregates.min_by_k(rows, "a", "v", 4, filter_mode="later")


def test_blocks_of_both_sides_and_ids_of_any_kind(base, monkeypatch):
    """Small blocks of queries and rows, few queries at a time, and ids that are strings: as one block."""
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, blocks.many_nearest(base, asked, 4).collect()))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 3 * 40)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    assert sorted(map(tuple, blocks.many_nearest(base, asked, 4, broadcast_bytes=0).collect())) == want
    named = base.withColumn("vec_id", F.format_string("%05d", "vec_id"))
    for size in (0, 1 << 20):
        got = sorted((q, int(i), d, n) for q, i, d, n in blocks.many_nearest(named, asked, 4, broadcast_bytes=size).collect())
        assert got == want
