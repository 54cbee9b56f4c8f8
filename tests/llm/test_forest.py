import numpy as np
import pytest

from nearfield.llm import forest as Fo
from nearfield.llm.queries import DIM, ORACLES, p3_found, p3_neighbours
from nearfield.operators import knn as K
from nearfield.operators.points import current_usable
from nearfield.plans.tables import table
from tests.oracle import DATA, check


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "clash") for i, r in zip(ids if ids is not None else range(len(x)), x)], "id long, data array<float>, distance string")


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 40, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)


def test_prefix_ranges_hold_exactly_the_rows_with_that_prefix():
    x = clustered(500, 16)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    f = Fo.Forest(u, 2, 1)
    strings = f.strings(u)
    for level in (0, 1, 7, 40, 64):
        lo, hi = f.prefix_ranges(strings[:, :30], np.full(30, level))
        for t in range(2):
            for q in range(30):
                same = (strings[t] >> np.uint64(64 - level) if level else np.zeros(500, np.uint64)) == (strings[t, q] >> np.uint64(64 - level) if level else 0)
                assert hi[t, q] - lo[t, q] == same.sum()


def test_recall_against_brute_force(spark):
    x = clustered(4000, 32)
    p = frame(spark, x)
    q = p.where("id % 20 = 0")
    near = {(r["query_id"], r["id"]) for r in Fo.similar_vectors(p, q, 10, 32, recall=0.95).collect()}
    exact = {(r["query_id"], r["id"]) for r in K.knn(p, q, 10, 32, drop_self=True).collect()}
    assert len(near) == len(exact) == 2000
    assert len(near & exact) / len(exact) >= 0.9


def test_recall_on_the_tables(spark):
    u = current_usable(table(spark, "/root/testdata/sf0.01", "points"), DIM)
    q = u.where("id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in K.knn(u, q, 10, DIM, drop_self=True).collect()}
    near = {(r["query_id"], r["id"]) for r in p3_neighbours(spark, "/root/testdata/sf0.01").collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_probes_agree_with_sql(spark):
    check(spark, p3_found, ORACLES["p3_found"])


@pytest.mark.parametrize("drop", [True, False])
def test_ties_copies_and_few_points(spark, drop):
    x = np.array([[1, 0], [1, 0], [2, 0], [0, 1], [-1, 0]], np.float32)
    p = frame(spark, x, [5, 3, 4, 2, 1])
    q = p.where("id = 5")
    got = [r["id"] for r in Fo.similar_vectors(p, q, 3, 2, drop_self=drop).orderBy("rank").collect()]
    assert got == ([3, 4, 2] if drop else [3, 4, 5])
    assert Fo.similar_vectors(p, q, 50, 2, drop_self=drop).count() == 5 - drop
    assert Fo.similar_vectors(p, q, 0, 2).count() == 0


def test_empty_and_single(spark):
    p = frame(spark, np.ones((1, 4), np.float32))
    assert Fo.similar_vectors(p, p, 3, 4).count() == 0
    assert Fo.similar_vectors(p.limit(0), p, 3, 4).count() == 0
    assert Fo.similar_vectors(p, p.limit(0), 3, 4).count() == 0


def test_a_third_of_all_points_are_copies():
    x = clustered(3000, 16)
    x[:1000] = x[0]
    ids = np.arange(3000)
    q, i, d = Fo.search_shard(ids, x.astype(float), ids[:3], x[:3].astype(float), None, 5, 8, 0.9, 1, True)
    for k in range(3):
        assert (d[q == k] < 1e-12).all() and sorted(i[q == k]) == [j for j in range(6) if j != k][:5]


def test_several_shards_merge(spark, monkeypatch):
    monkeypatch.setattr(Fo, "SHARD_ROWS", 300)
    x = clustered(1500, 16)
    p = frame(spark, x)
    q = p.where("id < 20")
    exact = {(r["query_id"], r["id"]) for r in K.knn(p, q, 5, 16, drop_self=True).collect()}
    near = {(r["query_id"], r["id"]) for r in Fo.similar_vectors(p, q, 5, 16).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    assert {(r["query_id"], r["id"]) for r in Fo.similar_vectors(p, q, 5, 16, recall=1).collect()} == exact


def test_queries_in_dense_places_open_short_ranges():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(32) + 0.05 * rng.standard_normal((200, 32)), rng.standard_normal((8000, 32))]).astype(float)
    q, opened = np.r_[:40, 4000:4040], []
    first = Fo.search_shard(np.arange(len(x)), x, q, x[q], None, 10, Fo.TREES, Fo.RECALL, 1, True)
    kth = np.array([np.sort(first[2][first[0] == i])[9:10].sum() or np.nan for i in q])
    ids, near, dist = Fo.search_shard(np.arange(len(x)), x, q, x[q], kth, 10, Fo.TREES, Fo.RECALL, 1, True, opened)
    sizes = np.concatenate(opened)
    assert sizes[:40].max() < 0.3 * len(x) and sizes[40:].min() > np.median(sizes[:40])
    assert (dist <= kth[np.searchsorted(q, ids)] + 1e-9).all()


def test_prefix_needed_for_a_distance():
    got = Fo.needed_prefix(np.array([0.0, 0.01, 0.4, np.nan]), 24, 0.97)
    assert got[0] == 64 and got[0] > got[1] > got[2] > got[3] == 0
    same = 1 - np.arccos(1 - 0.01) / np.pi
    assert 1 - (1 - same ** got[1]) ** 24 >= 0.97 > 1 - (1 - same ** (got[1] + 1)) ** 24


def test_null_ids_take_no_part(spark):
    p = spark.createDataFrame([(None, [1.0, 0.0], None), (1, [1.0, 0.0], None), (2, [0.0, 1.0], None)], "id long, data array<float>, distance string")
    assert {(r["query_id"], r["id"]) for r in Fo.similar_vectors(p, p, 5, 2).collect()} == {(1, 2), (2, 1)}


def test_copies_before_a_row():
    assert Fo._copies_before(np.array([[1.0, 0.0], [2.0, 0.0], [1.0, -0.0], [1.0, 0.0]])).tolist() == [0, 0, 1, 2]
    assert Fo._copies_before(np.zeros((0, 3))).tolist() == []
