"""Differences between two copies of a table, row by row and field by field.

Repeated rows are reduced before the first shuffle (a partial aggregate per key), so a key that holds a third of all
rows arrives as a few rows. Both sides are then cogrouped by hash bucket as Arrow tables; inside a bucket keys are
aligned by sorted search and every column is compared by one vectorised, null-aware mask. Only masked cells leave. Keys that
have several different rows on a side are only named there; their sets of values are compared afterwards, value by value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialize, parallelism

#: Rows of both sides in one bucket, about; it bounds the memory of a task.
BUCKET_ROWS = 40_000
#: Stands for a field in the rows of compare_bucket that only name a key with several different rows.
SEVERAL = ""


def equal_mask(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where a and b hold the same value: null equals null, NaN equals NaN, 0.0 equals -0.0, lists element by element in order."""
    if isinstance(a, pa.ChunkedArray):
        a, b = a.combine_chunks(), b.combine_chunks()
    null_a, null_b = (x.is_null().to_numpy(zero_copy_only=False) for x in (a, b))
    out = null_a & null_b
    both = np.nonzero(~null_a & ~null_b)[0]
    if not len(both):
        return out
    a, b = a.take(pa.array(both)), b.take(pa.array(both))
    if pa.types.is_struct(a.type):
        same = np.ones(len(both), bool)
        for i in range(a.type.num_fields):
            same &= equal_mask(pc.struct_field(a, i), pc.struct_field(b, i))
    elif pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        n, m = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        same = n == m
        pick = pa.array(np.nonzero(same)[0])
        elements = equal_mask(a.take(pick).flatten(), b.take(pick).flatten())
        ends = np.cumsum(n[same])
        wrong = np.concatenate([[0], np.cumsum(~elements)])
        same[np.nonzero(same)[0]] = wrong[ends] == wrong[ends - n[same]]
    elif pa.types.is_floating(a.type):
        x, y = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        same = (x == y) | (np.isnan(x) & np.isnan(y))
    else:
        same = pc.equal(a, b).to_numpy(zero_copy_only=False)
    out[both] = same
    return out


def _text(column: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    taken = column.take(pa.array(at)).to_pylist()
    return pa.array([None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v) for v in taken], pa.string())


def compare_bucket(left: pa.Table, right: pa.Table, fields: list[str], values: bool) -> pa.Table:
    """The differing cells of one bucket. Each side has a row per key: _k, the fields, and _several if the key has different rows, which are not compared here."""
    sides = []
    for t in (left, right):
        t = t.combine_chunks().sort_by("_k")
        sides.append((t, np.asarray(t["_k"].to_pylist(), object)))
    (a, ka), (b, kb) = sides
    at = np.searchsorted(kb, ka) if len(kb) else np.zeros(len(ka), np.int64)
    hit = np.zeros(len(ka), bool)
    inside = at < len(kb)
    hit[inside] = kb[at[inside]] == ka[inside]
    alone = np.ones(len(kb), bool)
    alone[at[hit]] = False
    keys, kinds, first, second = [], [], [], []

    def emit(k, kind, x=None, y=None):
        keys.append(pa.array(list(k), pa.string()))
        kinds.append(pa.array([kind] * len(k), pa.string()))
        nothing = pa.nulls(len(k), pa.string())
        first.append(nothing if x is None else x)
        second.append(nothing if y is None else y)

    emit(ka[~hit], "only_first")
    emit(kb[alone], "only_second")
    ia, ib = np.nonzero(hit)[0], at[hit]
    several = a["_several"].take(pa.array(ia)).to_numpy() | b["_several"].take(pa.array(ib)).to_numpy()
    emit(ka[ia[several]], SEVERAL)
    ia, ib = ia[~several], ib[~several]
    ta, tb = a.take(pa.array(ia)), b.take(pa.array(ib))
    for f in fields:
        off = np.nonzero(~equal_mask(ta[f], tb[f]))[0]
        if len(off):
            emit(ka[ia[off]], f, *((_text(ta[f], off), _text(tb[f], off)) if values else ()))
    names = ["_k", "diff", "first", "second"]
    return pa.table(dict(zip(names, (pa.chunked_array(x, pa.string()) for x in (keys, kinds, first, second)))))


def diff_tables(first: DataFrame, second: DataFrame, key: str, fields: list[str], name: str, values: bool = False) -> DataFrame:
    """table_name, row_key, diff (only_first, only_second or a field's name), and with values=True both values as text.

    A row per differing cell. Rows that repeat count once. A null key is a key like any other, and row_key is null for it.
    Where a side has several different rows of one key, a field differs if the two sides don't hold the same set of values in it; there is no one value to
    show then, and first and second are null. Columns other than key and fields don't matter, whatever their names. Empty tables are fine.
    """
    spark = first.sparkSession
    n = first.count() + second.count()
    buckets = max(parallelism(spark), -(-n // BUCKET_ROWS))

    def tagged(df: DataFrame) -> DataFrame:
        return df.select(F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")).alias("_k"), F.struct(*[F.col(f) for f in fields]).alias("_row"))

    def side(df: DataFrame) -> DataFrame:
        one = tagged(df).groupBy("_k").agg(F.min("_row").alias("_lo"), F.max("_row").alias("_hi"))
        return one.select(F.pmod(F.xxhash64("_k"), F.lit(buckets)).cast("int").alias("_b"), "_k", *[F.col(f"_lo.{f}").alias(f) for f in fields], (~F.col("_lo").eqNullSafe(F.col("_hi"))).alias("_several"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return compare_bucket(left, right, fields, values)

    cells = materialize(side(first).groupBy("_b").cogroup(side(second).groupBy("_b")).applyInArrow(compare, "_k string, diff string, first string, second string"), "cells")
    several, out = cells.where(F.col("diff") == SEVERAL).select("_k"), cells.where(F.col("diff") != SEVERAL)
    if not several.isEmpty():
        sides = [tagged(df).join(several, "_k", "left_semi") for df in (first, second)]
        for f in fields:  # the groups are values, so a key with many rows is spread
            both = sides[0].select("_k", f"_row.{f}", F.lit(1).alias("_s")).unionAll(sides[1].select("_k", f"_row.{f}", F.lit(2)))
            one_sided = both.groupBy("_k", f).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a = _b").select("_k").distinct()
            out = out.unionAll(one_sided.select("_k", F.lit(f).alias("diff"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second")))
    out = out.select(F.lit(name).alias("table_name"), F.when(F.col("_k") != "n", F.expr("substring(_k, 2)")).alias("row_key"), "diff", "first", "second")
    return out if values else out.drop("first", "second")
