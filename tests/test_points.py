import pytest
from pyspark.sql import functions as F

from nearfield.operators import points as P


def test_latest_takes_the_greatest_seq_and_keeps_all_columns(spark):
    df = spark.createDataFrame([("a", 1, 10, "x"), ("a", 2, 20, None), ("a", 2, 20, None), (None, 1, 5, "n"), ("b", 1, 30, "y")], "label string, seq long, id int, note string")
    assert {(r["label"], r["id"], r["note"]) for r in P.latest(df).collect()} == {("a", 20, None), (None, 5, "n"), ("b", 30, "y")}
    assert P.latest(df.limit(0)).count() == 0


def test_current_usable_hides_older_versions_behind_a_bad_one(spark):
    rows = [("a", 1, 1, [1.0, 0.0]), ("a", 1, 2, [0.0, 0.0]), ("b", 2, 1, [0.0, 1.0]), ("b", 2, 1, [0.0, 1.0]), ("c", 3, 1, [1.0]), ("d", 4, 1, None), ("e", 5, 1, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "label string, id int, seq long, data array<float>")
    assert [(r["label"], r["id"]) for r in P.current_usable(df, 2).collect()] == [("b", 2)]
    assert [r["id"] for r in P.current_packed(df, 2).collect()] == [2]
    assert P.current_packed(df.limit(0), 2).count() == 0


def test_upsert_and_remove(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "label string, id long")
    new = spark.createDataFrame([("b", 7, "p"), ("c", 3, "q")], "label string, id long, extra string")
    merged = {(r["label"], r["id"], r["extra"]) for r in P.upsert(old, new).collect()}
    assert merged == {("a", 1, None), ("b", 7, "p"), ("c", 3, "q")}
    gone = spark.createDataFrame([(1,), (1,), (None,), (99,)], "id long")
    assert [r["id"] for r in P.remove(old, gone).collect()] == [2]
    assert P.remove(old, old).count() == 0


def test_ids_are_reused_in_ascending_order(spark):
    new = spark.createDataFrame([("d",), ("b",), ("c",), ("a",)], "label string")
    free = spark.createDataFrame([(9,), (4,), (4,), (None,)], "id int")
    got = {r["label"]: r["id"] for r in P.allocate_ids(new, free, 20).collect()}
    assert got == {"a": 4, "b": 9, "c": 20, "d": 21}
    assert P.allocate_ids(new.limit(0), free, 20).count() == 0
    assert sorted(r["id"] for r in P.allocate_ids(new, free.limit(0), 5).collect()) == [5, 6, 7, 8]


def test_numbers_run_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert P.numbered(df, [F.col("x")], "n").where("x <> n").count() == 0


def test_random_points_are_reproducible_and_of_unit_length(spark):
    a, b = (P.random_points(spark, 50, 8, seed=5, start_id=10) for _ in range(2))
    assert a.exceptAll(b).count() == 0
    assert {r["label"] for r in a.collect()} == {str(10 + i) for i in range(50)}
    lengths = a.select(F.aggregate("data", F.lit(0.0), lambda s, x: s + x * x).alias("l")).collect()
    assert all(r["l"] == pytest.approx(1, abs=1e-5) for r in lengths)


def test_levels_fall_off_by_the_rate(spark):
    n = spark.range(20_000).select(P.level(F.col("id").cast("string")).alias("l")).groupBy("l").count().collect()
    counts = {r["l"]: r["count"] for r in n}
    assert counts[0] / 20_000 == pytest.approx(15 / 16, abs=0.01) and counts[1] / 20_000 == pytest.approx(15 / 256, abs=0.01)
