import itertools

import numpy as np

from nearfield.llm import subset as S
from nearfield.llm.queries import p5_represented, p5_subset
from tests.oracle import DATA


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id long, data array<float>, rank int")


def unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_gains_multiply_to_the_determinant_and_greedy_is_greedy():
    rng = np.random.default_rng(3)
    u, w = unit(rng.standard_normal((40, 6))), rng.uniform(1, 2, 40)
    at, gains = S.greedy(u, np.arange(40), w, 8)
    kernel = np.sqrt(np.outer(w, w)) * np.exp((u.astype(float) @ u.T - 1) / S.WIDTH)
    assert np.isclose(np.linalg.det(kernel[np.ix_(at, at)]), gains.prod(), rtol=1e-3)
    for t in range(1, 8):
        best = max((np.linalg.det(kernel[np.ix_([*at[:t], j], [*at[:t], j])]) for j in range(40) if j not in at[:t]))
        assert np.isclose(np.linalg.det(kernel[np.ix_(at[: t + 1], at[: t + 1])]), best, rtol=1e-3)


def test_greedy_is_near_the_best_subset():
    rng = np.random.default_rng(4)
    u = unit(rng.standard_normal((12, 3)))
    kernel = np.exp((u.astype(float) @ u.T - 1) / S.WIDTH)
    at, _ = S.greedy(u, np.arange(12), np.ones(12), 4)
    best = max(np.linalg.det(kernel[np.ix_(c, c)]) for c in itertools.combinations(range(12), 4))
    assert np.linalg.det(kernel[np.ix_(at, at)]) >= 0.5 * best


def test_large_groups_do_not_fill_the_subset(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 500)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    sizes = [2000, 500] + [8] * 28
    x = np.concatenate([c + 0.05 * rng.standard_normal((n, 16)) for c, n in zip(centres, sizes)])
    group = np.repeat(np.arange(30), sizes)
    got = S.varied_subset(frame(spark, x).repartition(4), 16, 30).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 31))
    hit = np.bincount(group[[r["id"] for r in got]], minlength=30)
    assert (hit > 0).sum() >= 28 and hit.max() <= 2


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 100)
    p = frame(spark, np.random.default_rng(8).standard_normal((400, 8)))
    assert len({tuple(tuple(r) for r in S.varied_subset(p.repartition(k), 8, 15).orderBy("rank").select("id", "rank").collect()) for k in (1, 5)}) == 1


def test_merging_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 50)
    monkeypatch.setattr(S, "FAN_IN", 2)
    x = np.random.default_rng(6).standard_normal((600, 8))
    assert S.varied_subset(frame(spark, x).repartition(3), 8, 20).select("id").distinct().count() == 20


def test_copies_few_points_and_empty(spark):
    x = np.array([[1, 0], [1, 0], [2, 0], [0, 1]], np.float32)
    p = frame(spark, x)
    got = S.varied_subset(p, 2, 3).orderBy("rank").collect()
    assert {r["id"] for r in got[:2]} == {0, 3} and got[2]["id"] == 1 and got[2]["gain"] == 0
    assert S.varied_subset(p.unionAll(p), 2, 10).count() == 4
    assert S.varied_subset(p, 2, 0).count() == 0 and S.varied_subset(p.limit(0), 2, 5).count() == 0


def test_queries(spark):
    chosen = p5_subset(spark, DATA)
    assert chosen.count() == 256 and chosen.select("id").distinct().count() == 256
    per = p5_represented(spark, DATA)
    assert per.agg({"n_points": "sum"}).first()[0] > 256


def test_null_ids_take_no_part(spark):
    p = spark.createDataFrame([(None, [1.0, 0.0], None), (1, [1.0, 0.0], None), (2, [0.0, 1.0], None)], "id long, data array<float>, rank int")
    assert {r["id"] for r in S.varied_subset(p, 2, 5).collect()} == {1, 2}


def test_weights_count_all_points(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 300)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((2, 24))
    x = np.concatenate([centres[0] + 0.05 * rng.standard_normal((16, 24)), centres[1] + 0.05 * rng.standard_normal((9, 24)), rng.standard_normal((1500, 24))])
    got = S.varied_subset(frame(spark, x).repartition(8), 24, 20).orderBy("rank").collect()
    assert got[0]["id"] < 16 <= got[1]["id"] < 25 <= min(r["id"] for r in got[2:])
    assert np.isclose(got[0]["gain"], 1 + S.EMPHASIS * np.log(16)) and np.isclose(got[1]["gain"], 1 + S.EMPHASIS * np.log(9), rtol=0.05)
