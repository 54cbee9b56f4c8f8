import pytest
from pyspark.sql import functions as F

from nearfield.index import IndexParams, VectorIndex
from nearfield.operators.points import random_points
from nearfield.sources.store import IndexStore, slices
from nearfield.streaming.changes import apply_changes, follow, latest_stream


@pytest.fixture()
def index(spark):
    return VectorIndex.empty(spark, 2).add(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "label string, data array<float>"))


def ids(ix):
    return {r["label"]: r["id"] for r in ix.items().collect()}


def test_add_upsert_remove_and_reuse_of_ids(spark, index):
    assert ids(index) == {"a": 0, "b": 1, "c": 2}
    gone = index.remove(spark.createDataFrame([(1,), (1,), (77,)], "id long"))
    assert ids(gone) == {"a": 0, "c": 2} and ids(index) == {"a": 0, "b": 1, "c": 2}
    again = gone.add(spark.createDataFrame([("d", [2.0, 1.0]), ("a", [0.0, 3.0]), ("e", [5.0, 1.0])], "label string, data array<float>"))
    assert ids(again) == {"a": 0, "c": 2, "d": 1, "e": 3}
    assert [r["data"] for r in again.items().where("label = 'a'").collect()] == [[0.0, 3.0]]
    assert again.remove(again.items().select("label")).count() == 0


def test_bad_points_are_kept_aside(spark, index):
    ix = index.add(spark.createDataFrame([("z", [0.0, 0.0]), ("n", [float("nan"), 1.0]), ("a", [1.0])], "label string, data array<float>"))
    assert {(r["label"], r["reason"]) for r in ix.bad_points.collect()} == {("z", "zero"), ("n", "not_finite"), ("a", "dimension")}
    assert ids(ix) == ids(index)
    marked = ix.mark_bad(spark.createDataFrame([("lost",), ("lost",), (None,)], "label string"))
    assert {r["label"] for r in marked.bad_points.collect()} == {"z", "n", "a", "lost"} and marked.bad_points.count() == 4


def test_queries_on_an_empty_index(spark):
    e = VectorIndex.empty(spark, 2)
    assert e.query([1.0, 0.0], 3).count() == 0 and e.count() == 0 and e.info().count() == 0
    with pytest.raises(ValueError, match="layer"):
        e.query([1.0, 0.0], 3, layer=2)


def test_query_with_payload_and_filter(spark):
    ix = VectorIndex.empty(spark, 2, payload=", t int").add(spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [1.0, 0.1], 2)], "label string, data array<float>, t int"))
    assert [r["label"] for r in ix.query([1.0, 0.0], 5, where=F.col("t") > 1).collect()] == ["b"]


def test_graph_recall_balance_and_removal(spark):
    p = random_points(spark, 600, 32, seed=9, start_id=0).withColumn("id", F.col("id").cast("long"))
    ix = VectorIndex(p, 32).build(shards=3)
    ix.nodes.cache()
    hits = ix.query_approximate(p, 1).where("id = query_id").count()
    assert hits / 600 > 0.9
    for r in ix.info().collect():
        assert r["avg_out"] == pytest.approx(r["avg_in"]) and r["max_out"] <= (32 if r["layer"] == 0 else 16)
    half = ix.remove(p.where("id % 2 = 1").select("id"))
    assert half.nodes.count() == 300
    found = half.query_approximate(p.where("id % 2 = 0"), 1)
    assert found.where("id = query_id").count() / 300 > 0.9 * hits / 600
    assert found.where("id % 2 = 1").count() == 0
    only = ix.query_approximate(p.where("id < 5"), 3, where=F.col("label") == "17")
    assert {r["id"] for r in only.collect()} == {17} and only.count() == 5
    assert half.remove(p.select("id")).query_approximate(p.where("id < 5"), 3).count() == 0


def test_store_versions_names_slices_and_equality(spark, index, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    assert store.load("main") is None and store.names() == [] and store.node_count("main") == 0
    assert store.save("main", index, slice_rows=1) == 1
    first = store.load("main")
    assert first.same_as(index) and store.node_count("main") == 3
    changed = index.remove(spark.createDataFrame([(0,)], "id long"))
    assert store.save("main", changed, expected=1) == 2
    assert [(v["version"], v["rows"]["points"], v["current"]) for v in store.history("main")] == [(1, 3, False), (2, 2, True)] and store.history("none") == []
    assert not store.load("main").same_as(index) and first.count() == 3
    with pytest.raises(RuntimeError):
        store.save("main", index, expected=1)
    store.save("other", VectorIndex(index.points, 2, params=IndexParams(max_edges=8)))
    assert store.names() == ["main", "other"] and store.load("other").params.max_edges == 8
    assert store.vacuum("main") == [1] and store.load("main").count() == 2
    store.save_config("k", [1, 2])
    assert store.get_config("k") == [1, 2] and store.get_config("none") is None
    with pytest.raises(PermissionError):
        IndexStore(spark, str(tmp_path), read_only=True).save("main", index)
    store.drop("other")
    assert store.names() == ["main"]


def test_of_two_writers_of_a_version_one_commits(spark, index, tmp_path):
    a, b = IndexStore(spark, str(tmp_path)), IndexStore(spark, str(tmp_path))
    a.save("main", index)
    b.version = lambda name: None  # a writer that began before
    with pytest.raises(RuntimeError, match="committed"):
        b.save("main", index.remove(spark.createDataFrame([(0,)], "id long")))
    assert a.version("main") == 1 and a.load("main").same_as(index)


def graph_of(spark, n, dim=32, seed=9, metric="cosine", shards=3):
    p = random_points(spark, n, dim, seed=seed, start_id=0).withColumn("id", F.col("id").cast("long"))
    ix = VectorIndex(p, dim, metric=metric).build(shards=shards)
    ix.nodes.cache()
    return p, ix


def self_recall(ix, p):
    return ix.query_approximate(p, 1).where("id = query_id").count() / p.count()


def test_points_are_added_to_a_graph_and_only_touched_shards_are_written(spark, tmp_path):
    p, ix = graph_of(spark, 600, shards=5)
    store = IndexStore(spark, str(tmp_path))
    store.save("g", ix)
    loaded = store.load("g")
    assert loaded.same_as(ix) and loaded.shards == 5 and store.history("g")[0]["entry_point"] == ix.entry_point().first()["id"]
    more = random_points(spark, 2, 32, seed=77, start_id=1000).drop("id").unionByName(p.where("id = 5").select(F.lit("6").alias("label"), "data"))
    grown = loaded.add(more)
    assert grown.nodes.count() == 602 and grown.count() == 602
    store.save("g", grown)
    last = store.load("g")
    assert last.same_as(grown) and not last.same_as(ix) and 1 <= store.history("g")[1]["written_shards"] <= 3
    new = grown.points.where("label in ('1000', '1001')")
    assert last.query_approximate(new, 1).where("id = query_id").count() == 2
    twins = {r["id"] for r in last.query_approximate(p.where("id = 5"), 2).collect()}
    assert twins == {5, 6}  # the replaced point is found at its new place
    assert store.vacuum("g") == [1] and store.load("g").same_as(last)
    for r in last.info().collect():
        assert r["avg_out"] == pytest.approx(r["avg_in"]) and r["max_out"] <= (32 if r["layer"] == 0 else 16)


def test_a_graph_grown_in_steps_finds_as_well_as_one_built_at_once(spark):
    p, ix = graph_of(spark, 1000, shards=1)
    part = VectorIndex(p.where("id < 500"), 32).build(shards=1)
    part = part.add(p.where("id >= 500").drop("id"))
    part.nodes.cache()
    assert self_recall(ix, p) > 0.85 and self_recall(part, p) > 0.85
    half = part.remove(p.where("id % 2 = 1").select("id"))
    kept = p.where("id % 2 = 0")
    assert self_recall(half, kept) > 0.9 * self_recall(part, kept)


@pytest.mark.parametrize(("params", "least"), [(IndexParams(max_candidates=32), 0.9), (IndexParams(min_nn=50), 0.95), (IndexParams(max_edges=32), 0.95)])
def test_recall_of_parameters_and_squared_euclidean(spark, params, least):
    p = random_points(spark, 500, 32, seed=4, normalize=False, start_id=0).withColumn("id", F.col("id").cast("long"))
    ix = VectorIndex(p, 32, metric="sqeuclidean", params=params).build(shards=1)
    assert self_recall(ix, p) >= least


def test_max_candidates_is_used_as_given():
    import numpy as np

    from nearfield.operators import hnsw

    rng = np.random.default_rng(1)
    x, level = rng.standard_normal((400, 8)), np.zeros(400, np.int64)
    narrow, wide = (hnsw.build(np.arange(400), x, level, max_edges=4, max_candidates=m) for m in (150, 399))
    assert narrow.out != wide.out


def test_metric_of_the_caller_in_plans_blocks_and_graphs(spark):
    import numpy as np

    from nearfield.functions.vectors import CustomMetric
    from nearfield.operators.knn import knn, knn_plan

    manhattan = CustomMetric(lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v), lambda q, x: np.abs(q[:, None, :] - x[None, :, :]).sum(axis=2))
    p = random_points(spark, 200, 8, seed=2, normalize=False, start_id=0).withColumn("id", F.col("id").cast("long"))
    q = p.where("id < 20")
    key = lambda df: {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}
    want = key(knn_plan(p, q, 5, manhattan))
    assert key(knn(p, q, 5, 8, manhattan)) == want and key(VectorIndex(p, 8, metric=manhattan).query_batch(q, 5)) == want
    assert self_recall(VectorIndex(p, 8, metric=manhattan).build(shards=1), q) == 1
    with pytest.raises(ValueError, match="manhattan"):
        knn(p, q, 5, 8, "manhattan")


def test_graph_layers_without_a_graph(spark, index):
    assert index.graph_layer(0).count() == 0 and index.graph_layer(3).count() == 0


def test_slices(spark):
    df = spark.range(25).toDF("id")
    assert {(r["slice_no"], r["n_rows"]) for r in slices(df, 10).collect()} == {(1, 10), (2, 10), (3, 5)}
    assert slices(df.limit(0), 10).count() == 0


def test_changes_are_applied_once_and_last_wins(spark, index, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.save("main", index)
    ch = spark.createDataFrame([("put", "a", [9.0, 1.0], 2), ("remove", "a", None, 1), ("remove", "b", None, 3)], "op string, label string, data array<float>, seq long")
    assert apply_changes(store, "main", ch, batch_id=0) == 2
    assert {r["label"] for r in store.load("main").items().collect()} == {"a", "c"}
    assert apply_changes(store, "main", ch, batch_id=0) == 2 and store.marks("main") == {"batch": 0}
    with pytest.raises(ValueError):
        apply_changes(store, "absent", ch)


def test_stream_of_changes(spark, index, tmp_path):
    store = IndexStore(spark, str(tmp_path / "store"))
    store.save("main", index)
    schema = "op string, label string, data array<float>, seq long"
    spark.createDataFrame([("put", "new", [1.0, 5.0], 1), ("remove", "c", None, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = follow(store, "main", spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert {r["label"] for r in store.load("main").items().collect()} == {"a", "b", "new"}


def test_changes_per_window_with_a_watermark(spark, tmp_path):
    schema = "label string, t timestamp"
    rows = [("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00"), ("a", "2024-01-01 00:11:00"), ("late", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "label string, t string").selectExpr("label", "cast(t as timestamp) t").coalesce(1).write.parquet(str(tmp_path / "in"))
    w = latest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "t", "5 minutes", "10 minutes")
    q = w.writeStream.format("memory").queryName("per_window").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert [(r["n"], r["labels"]) for r in spark.sql("SELECT * FROM per_window ORDER BY start").collect()] == [(2, 2), (1, 1)]


def test_command_line(spark, tmp_path, capsys):
    from nearfield.__main__ import main

    main(["stress", "--count", "60", "--dim", "8", "--store", str(tmp_path)])
    main(["load", str(tmp_path), "stress"])
    out = capsys.readouterr().out
    assert "60 points, 8 dimensions" in out and "max_edges: 16" in out
