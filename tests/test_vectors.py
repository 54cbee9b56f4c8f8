import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.functions import vectors as V

PAIRS = [([1.0, 2.0, 3.0], [2.0, 0.5, -1.0]), ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), ([1.0, 1.0, 1.0], [1.0, 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), ([1.0, 2.0], [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("name", sorted(V.METRICS))
def test_metrics_agree_with_numpy(spark, name):
    df = spark.createDataFrame(PAIRS, "a array<float>, b array<float>").withColumn("d", V.metric(name)(F.col("a"), F.col("b")))
    for r in df.collect():
        if r["a"] is None or len(r["a"]) != len(r["b"]):
            assert r["d"] is None
        else:
            assert r["d"] == pytest.approx(kernels.SCALAR[name](np.array(r["a"]), np.array(r["b"])), abs=1e-9)


def test_zero_vector_has_cosine_distance_one_and_no_direction(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b")).alias("d"), V.normalize(F.col("a")).alias("n"), V.is_empty(F.array()).alias("e")).first()
    assert r["d"] == 1.0 and r["n"] is None and r["e"]


def test_blocks_and_rows_agree_with_scalars():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((7, 100)), rng.standard_normal((9, 100))
    for name, f in kernels.SCALAR.items():
        block = kernels.block(name, a, b)
        want = np.array([[f(x, y) for y in b] for x in a])
        assert np.abs(block - want).max() < 1e-6
        assert np.abs(kernels.rowwise(name, a, b[:7]) - want[range(7), range(7)]).max() < 1e-9


def test_unusable_reasons(spark):
    nan, inf = float("nan"), float("inf")
    data = [(None, "null"), ([], "empty"), ([1.0], "dimension"), ([1.0, None], "null_element"), ([nan, 1.0], "not_finite"), ([-inf, 1.0], "not_finite"), ([0.0, -0.0], "zero"), ([1.0, 0.0], None)]
    df = spark.createDataFrame(data, "data array<float>, want string").withColumn("got", V.unusable_reason(F.col("data"), 2))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_sql_functions_and_unknown_metric(spark):
    V.register(spark)
    df = spark.createDataFrame([p for p in PAIRS if p[0] and len(p[0]) == len(p[1])], "a array<float>, b array<float>")
    df.createOrReplaceTempView("pairs")
    for name in V.METRICS:
        got = spark.sql(f"SELECT a, b, vec_{name}(a, b) AS d FROM pairs")
        assert "Python" not in got._jdf.queryExecution().toString()
        for r in got.collect():
            assert r["d"] == pytest.approx(kernels.SCALAR[name](np.array(r["a"]), np.array(r["b"])), abs=1e-9)
    r = spark.sql("SELECT vec_magnitude(array(3D, 4D)) AS m, vec_normalize(array(3D, 4D)) AS n, vec_normalize(array(0D)) AS z, vec_cosine(NULL, array(1D)) AS c, vec_dot(array(1D), array(1D, 2D)) AS d").first()
    assert (r["m"], r["n"], r["z"], r["c"], r["d"]) == (5.0, [0.6, 0.8], None, None, None)
    with pytest.raises(ValueError, match="unknown metric"):
        V.metric("manhattan")


def test_pack_is_lossless():
    x = np.array([[1.5, -0.25, 0.0], [math.pi, 1e-8, 3e38]], np.float32)
    packed = kernels.pack(x)
    assert [len(p) for p in packed] == [6, 12]
    assert (kernels.unpack(packed, 3, np.float32) == x).all()
    assert kernels.unpack([], 3).shape == (0, 3)
