import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.functions import codes
from nearfield.functions import distance as D
from nearfield.functions.sql import register


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, [float(x), float(y), float(z)]) for i, (x, y, z) in enumerate(np.ndindex(9, 9, 9))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(1)
    for n in (1, 3, 64, 65):
        a, b = rng.normal(size=n), rng.normal(size=n)
        got = one(spark, D.l2_distance(a, b), D.inner_product(a, b), D.negative_inner_product(a, b), D.cosine_similarity(a, b), D.cosine_distance(a, b))
        cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert np.allclose(got, [np.linalg.norm(a - b), a @ b, -(a @ b), cos, 1 - cos])


def test_zero_null_and_wrong_vectors(spark):
    assert one(spark, D.cosine_distance([0, 0], [1, 2]), D.cosine_similarity([0, 0], [0, 0]))[:] == (1.0, 0.0)
    assert one(spark, D.l2_distance(F.lit(None).cast("array<float>"), [1, 2]))[0] is None
    for bad in (D.l2_distance([1, 2, 3], [1, 2]), D.inner_product(F.array(F.lit(None).cast("double"), F.lit(1.0)), [1, 2])):
        with pytest.raises(PySparkException):
            one(spark, bad)
    with pytest.raises(ValueError):
        D.distance([1], [1], "manhattan")


@pytest.mark.parametrize("dims", [1, 63, 64, 65, 128])
def test_ternary_codes(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.integers(-1, 2, (20, dims)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").withColumn("c", codes.ternary_encode("v", dims))
    other = df.select(F.col("id").alias("j"), F.col("c").alias("d"))
    got = {(r[0], r[1]): r[2] for r in df.join(other, F.col("j") >= F.col("id")).select("id", "j", codes.ternary_dot(F.col("c"), F.col("d"))).collect()}
    want = np.sign(x) @ np.sign(x).T
    assert all(v == want[i, j] for (i, j), v in got.items()) and len(got) == 210
    pos, neg = codes.ternary_planes(x)
    assert (codes.ternary_scores(pos, neg, pos[:1], neg[:1]) == want[:, 0]).all()
    row = df.orderBy("id").first()
    assert [w % 2**64 for w in row["c"]["pos"]] == pos[0].tolist()
    signs = df.select("id", codes.sign_bits("v", dims).alias("s")).orderBy("id").collect()
    far = one(spark, codes.hamming(F.array(*map(F.lit, signs[0][1])), F.array(*map(F.lit, signs[1][1]))))[0]
    assert far == ((x[0] > 0) != (x[1] > 0)).sum()


def test_int8_and_float16(spark):
    v = [-2.0, -1.0, -0.999, 0.0, 0.5, 1.0, 3.0]
    assert one(spark, codes.int8_encode(v))[0] == [-127, -127, -126, 0, 63, 127, 127]
    half = spark.createDataFrame([([0.1, 2.0],), (None,)], "v array<float>").select(codes.float16_round_trip("v")).collect()
    assert half[0][0] == [np.float32(np.float16(0.1)), 2.0] and half[1][0] is None
    with pytest.raises(ValueError):
        codes.approximate_distance(F.col("a"), F.col("b"), "l2")


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT array_distance(array(1, 2), array(4, 6)), array_inner_product(array(1, 2), array(3, 4)), array_cosine_distance(array(0, 0), array(1, 1)), vector_score(array(1, 2), array(3, 4), 'IP')").first()
    assert got[:] == (5.0, 11.0, 1.0, 11.0)
    with pytest.raises(PySparkException):
        spark.sql("SELECT vector_score(array(1), array(1), 'chebyshev')").collect()
