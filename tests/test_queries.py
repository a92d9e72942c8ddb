"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from nearfield.plans.queries import SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6) + 0.0
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_oracle(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["vec_id", "label", "dist"] and found.first()["vec_id"] == 0


def test_plans_push_down(spark, sf):
    plan = entry.queries()["filter_pre"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan


WHOLE = ["lateral_join_l2", "lateral_join_cosine", "lateral_join_ip", "lateral_join_blocks", "index_join", "knn_join_l2sq", "knn_join_cosine", "knn_join_ip", "knn_match", "match_unnested"]


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_is_joined(spark, sf, name):
    """Each row of the table, of whatever label, has its neighbours."""
    got = entry.queries()[f"{name}_whole"](spark, sf)
    left = "query_id" if "query_id" in got.columns else "left_id"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    found = [r[0] for r in got.select(left).collect()]
    assert set(found) == ids and len(found) == len(ids) * (1 if name == "knn_match" else 5)
