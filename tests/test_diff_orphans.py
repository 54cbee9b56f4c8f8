import datetime as dt

import pyarrow as pa
import pytest

from nearfield.operators.diff import diff_tables, equal_mask
from nearfield.operators.orphans import direct_orphans, edge_references, key_references, orphan_cascade

NAN = float("nan")
POINT = "label string, id int, data array<float>, t timestamp"


def cells(df):
    return sorted(((r["row_key"], r["diff"]) for r in df.collect()), key=repr)


def test_masks_are_null_aware_and_nested():
    f = pa.list_(pa.float32())
    a = pa.array([[1.0, NAN], [], None, [1.0, None], [1.0], [0.0], [2.0, 3.0]], f)
    b = pa.array([[1.0, NAN], None, None, [1.0, 2.0], [1.0, 1.0], [-0.0], [3.0, 2.0]], f)
    assert equal_mask(a, b).tolist() == [True, False, True, False, False, True, False]
    n = pa.list_(pa.list_(pa.int32()))
    a = pa.array([[[1], []], [[1]], [None], [[1, 2]], []], n)
    b = pa.array([[[1], []], [[1], []], [[]], [[2, 1]], []], n)
    assert equal_mask(a, b).tolist() == [True, False, False, False, True]
    assert equal_mask(pa.array([], n), pa.array([], n)).tolist() == []
    assert equal_mask(pa.array(["a", None, ""]), pa.array(["a", "", None])).tolist() == [True, False, False]


def test_differences(spark):
    t = dt.datetime(2024, 1, 1)
    a = [("same", 1, [1.0, NAN], t), ("same", 1, [1.0, NAN], t), ("gone", 2, None, None), ("vec", 3, [1.0], t), ("null", 4, [], None), (None, 5, [1.0], t), ("Key", 6, [1.0], t)]
    b = [("same", 1, [1.0, NAN], t), ("new", 7, [1.0], t), ("vec", 3, [2.0], t), ("null", 4, None, t), (None, 6, [1.0], t), ("key", 6, [1.0], t)]
    got = diff_tables(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), "label", ["id", "data", "t"], "p")
    assert cells(got) == sorted([("gone", "only_first"), ("new", "only_second"), ("vec", "data"), ("null", "data"), ("null", "t"), (None, "id"), ("Key", "only_first"), ("key", "only_second")], key=repr)


def test_difference_of_empty_tables_and_values(spark):
    a = spark.createDataFrame([("x", 1, [1.0], None)], POINT)
    e = a.limit(0)
    fields = ["id", "data", "t"]
    assert diff_tables(e, e, "label", fields, "p").count() == 0
    assert cells(diff_tables(a, e, "label", fields, "p")) == [("x", "only_first")]
    assert cells(diff_tables(e, a, "label", fields, "p")) == [("x", "only_second")]
    b = spark.createDataFrame([("x", 2, [1.0], None)], POINT)
    r = diff_tables(a, b, "label", fields, "p", values=True).first()
    assert (r["diff"], r["first"], r["second"]) == ("id", "1", "2")


def test_several_rows_of_a_key_compare_as_sets(spark):
    rows = lambda *v: spark.createDataFrame([("k", i, [1.0], None) for i in v], POINT)
    assert cells(diff_tables(rows(1, 2), rows(2, 1), "label", ["id"], "p")) == []
    assert cells(diff_tables(rows(1, 2), rows(1, 3), "label", ["id"], "p")) == [("k", "id")]
    assert cells(diff_tables(rows(1, 2), rows(1), "label", ["id"], "p")) == [("k", "id")]
    assert cells(diff_tables(rows(1, 2, 3), rows(1, 3), "label", ["id", "data"], "p")) == [("k", "id")]
    assert cells(diff_tables(rows(1, 2, 3, 3), rows(3, 2, 1), "label", ["id", "data"], "p", values=True)) == []


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    a = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) label", "7 id", "array(1f) data", "cast(null as timestamp) t", "'clash' as diff", "1 as _b")
    assert diff_tables(a, a, "label", ["id", "data", "t"], "p").count() == 0


NODE = "id int, out_edges array<array<int>>, in_edges array<array<int>>, saved_at timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        (1, [[2, 3], [None, 9]], [[2]], day(0)),
        (1, [[2, 3], [None, 9]], [[2]], day(0)),
        (2, [[1]], None, day(8)),
        (3, [None, [4]], [[1]], None),
        (4, [[5]], [], day(1)),
        (5, [[6]], [], day(1)),
        (6, [[6]], [], day(1)),
        (None, [[99]], [], day(1)),
    ]
    return spark.createDataFrame(rows, NODE)


def test_reasons(spark, nodes):
    removed = spark.createDataFrame([(4, day(0)), (4, None), (77, day(1)), (None, None)], "index_id int, removed_at timestamp")
    refs = edge_references(nodes).unionByName(key_references(removed, "index_id", "removed_indexes", "removed_at"))
    got = direct_orphans(refs, nodes, removed.selectExpr("index_id as id"), missing_only=("removed_indexes",))
    found = {(r["ref_table"], r["ref_id"], r["ref_field"], r["target_id"], r["reason"]) for r in got.collect()}
    assert found == {
        ("store_nodes", 1, "out_edges", 9, "missing"),
        ("store_nodes", 1, "out_edges", 2, "late"),
        ("store_nodes", 1, "in_edges", 2, "late"),
        ("store_nodes", 3, "out_edges", 4, "removed"),
        ("removed_indexes", 77, "index_id", 77, "missing"),
    }


def test_exactly_seven_days_is_not_late(spark):
    n = spark.createDataFrame([(1, [[2]], [], day(0)), (2, [], [], day(7))], NODE)
    assert direct_orphans(edge_references(n), n, None).count() == 0


def test_cascade_reaches_a_fixpoint_through_cycles(spark):
    rows = [(1, [[99]], [], day(0)), (2, [[1]], [], day(0)), (3, [[2], [1]], [], day(0)), (4, [[3, 5]], [], day(0)), (5, [[4]], [], day(0)), (6, [[6]], [], day(0))]
    n = spark.createDataFrame(rows, NODE)
    refs = edge_references(n)
    all_ = orphan_cascade(refs, direct_orphans(refs, n, None), "store_nodes").collect()
    assert {(r["ref_id"], r["depth"]) for r in all_} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert {r["reason"] for r in all_ if r["depth"]} == {"inherited"}
    one = orphan_cascade(refs, direct_orphans(refs, n, None), "store_nodes", max_rounds=1).collect()
    assert {r["ref_id"] for r in one} == {1, 2, 3}


def test_no_references(spark, nodes):
    e = nodes.limit(0)
    refs = edge_references(e)
    assert orphan_cascade(refs, direct_orphans(refs, e, None), "store_nodes").count() == 0


def test_a_hot_target(spark):
    n = spark.range(1, 5000).selectExpr("cast(id as int) id", "array(array(0)) out_edges", "cast(null as array<array<int>>) in_edges", "timestamp'2024-01-01' saved_at")
    assert direct_orphans(edge_references(n), n, None).where("reason = 'missing' and target_id = 0").count() == 4999
