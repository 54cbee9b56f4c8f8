import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import knn as K

DIM = 8


def frame(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, data array<float>")


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(2).standard_normal((300, DIM)).astype(np.float32)


def brute(x, q, k, skip=None):
    a, b = x.astype(float), q.astype(float)
    d = 1 - (a @ b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b))
    return [i for i in np.lexsort((np.arange(len(x)), d)) if i != skip][:k]


def test_blocked_and_planned_forms_agree_with_brute_force(spark, vectors):
    p = frame(spark, vectors)
    q = p.where("id < 20")
    for form in (K.knn(p, q, 5, DIM, drop_self=True), K.knn_plan(p, q, 5, drop_self=True)):
        got = {}
        for r in form.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {i: brute(vectors, vectors[i], 5, i) for i in range(20)}


def test_query_blocks_cover_all_queries(spark, vectors, monkeypatch):
    p = frame(spark, vectors)
    m, blocks = K.query_blocks(p, DIM, size=40)
    assert m == 10 and sorted(i for ids, _ in blocks for i in ids.tolist()) == list(range(300))
    want = sorted(map(tuple, K.knn(p, p, 3, DIM).collect()))
    small = K.query_blocks
    monkeypatch.setattr(K, "query_blocks", lambda q, d: small(q, d, size=100))
    assert sorted(map(tuple, K.knn(p, p, 3, DIM).collect())) == want


def test_ties_repeats_and_bad_rows(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0]), (None, [1.0, 0.0]), (7, [1.0, None])]
    p = spark.createDataFrame(rows, "id long, data array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, data array<float>")
    assert [r["id"] for r in K.knn(p, q, 3, 2).orderBy("rank").collect()] == [1, 2, 3]
    assert K.knn(p, q, 0, 2).count() == 0 and K.knn(p, q, -1, 2).count() == 0
    assert K.knn(p, q, 100, 2).count() == 4
    assert K.knn(p.limit(0), q, 3, 2).count() == 0 and K.knn(p, q.limit(0), 3, 2).count() == 0


def test_filter_is_the_best_among_matches_and_reaches_the_scan(spark, vectors, tmp_path):
    frame(spark, vectors).withColumn("kind", F.col("id") % 3).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    q = frame(spark, vectors[:1])
    got = [r["id"] for r in K.knn(p, q, 4, DIM, where=F.col("kind") == 1).orderBy("rank").collect()]
    full = [r["id"] for r in K.knn(p, q, 300, DIM).orderBy("rank").collect()]
    assert got == [i for i in full if i % 3 == 1][:4]
    plan = K.knn_vector(p, vectors[0].tolist(), 3, where=F.col("kind") == 1)._jdf.queryExecution().toString()
    assert "EqualTo(kind,1)" in plan and "TakeOrderedAndProject" in plan


def test_top_k_is_a_prefix_and_shards_merge(spark, vectors):
    p, q = frame(spark, vectors), frame(spark, vectors[:3])
    ten = [(r["query_id"], r["rank"], r["id"]) for r in K.knn(p, q, 10, DIM).collect()]
    five = [(r["query_id"], r["rank"], r["id"]) for r in K.knn(p, q, 5, DIM).collect()]
    assert sorted(t for t in ten if t[1] <= 5) == sorted(five)
    parts = K.knn(p.where("id % 2 = 0"), q, 10, DIM).unionAll(K.knn(p.where("id % 2 = 1"), q, 10, DIM)).drop("rank")
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in K.top_k(parts, 10).collect()) == sorted(ten)


def test_user_metric(spark, vectors):
    p, q = frame(spark, vectors[:20]), frame(spark, vectors[:1])
    manhattan = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    got = [r["id"] for r in K.knn_plan(p, q, 3, manhattan).orderBy("rank").collect()]
    assert got == np.abs(vectors[:20] - vectors[0]).sum(axis=1).argsort()[:3].tolist()
    assert V.metric(manhattan) is manhattan
