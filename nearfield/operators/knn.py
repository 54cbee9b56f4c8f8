"""Exact k nearest neighbours. The order is always (distance, id), nulls and unusable vectors take no part.

knn_plan is one declarative plan (any metric as a Column function). knn computes the same by matrix products in
Arrow batches: query vectors go out in blocks of a fixed size, each batch of points keeps only its best k per query
before the one shuffle, which carries ids and distances and never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.functions.vectors import TINY, dot, magnitude
from nearfield.functions.vectors import metric as metric_of
from nearfield.session import materialize

#: Query vectors sent to the executors at once; the bound of what is broadcast.
QUERY_BLOCK, PLAN_BLOCK = 20_000, 1_000
FOUND = "query_id long, id long, distance double"


def knn_vector(points: DataFrame, vector: list[float], k: int, metric="cosine", where: Column | None = None) -> DataFrame:
    """The k points nearest to one vector: points' columns and distance. k <= 0 gives no rows, k above the count all rows.

    The filter runs before the distance and reaches the scan; the plan ends in TakeOrderedAndProject.
    """
    src = points if where is None else points.where(where)
    q = F.array(*[F.lit(float(v)) for v in vector])
    out = src.withColumn("distance", metric_of(metric)(F.col("data"), q)).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return out.orderBy("distance", "id").limit(max(0, k))


def knn_plan(points: DataFrame, queries: DataFrame, k: int, metric="cosine", where: Column | None = None, drop_self: bool = False) -> DataFrame:
    """query_id, id, distance, rank for a stated, small set of queries, as Catalyst plans for any metric.

    Each block of at most about PLAN_BLOCK queries is sent to all tasks and joined with the points where they lie; a task keeps k per query
    (WindowGroupLimit) before the shuffle. Rows whose distance is null or NaN never appear. For many queries use knn.
    """
    src = points if where is None else points.where(where)
    src, q = src.select("id", "data"), queries.select(F.col("id").alias("query_id"), F.col("data").alias("_q"))
    blocks = max(1, -(-q.count() // PLAN_BLOCK))
    if metric == "cosine":  # lengths once per row, not once per pair
        src, q = src.withColumn("_l", magnitude(F.col("data"))), q.withColumn("_m", magnitude(F.col("_q")))
        product = F.col("_l") * F.col("_m")
        distance = F.when(product < TINY, F.lit(1.0)).otherwise(1.0 - dot(F.col("data"), F.col("_q")) / product)
    else:
        distance = metric_of(metric)(F.col("data"), F.col("_q"))
    out = None
    for i in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        pairs = src.crossJoin(F.broadcast(block))
        if drop_self:
            pairs = pairs.where(F.col("id") != F.col("query_id"))
        found = top_k(pairs.select("query_id", "id", distance.alias("distance")), k)
        out = found if out is None else out.unionAll(found)
    return out


def top_k(distances: DataFrame, k: int) -> DataFrame:
    """Best k rows per query_id by (distance, id), with rank from 1. Null and NaN distances come last and are dropped."""
    w = W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    best = distances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, k))
    return best.where(F.col("distance").isNotNull() & ~F.isnan("distance"))


def query_blocks(queries: DataFrame, dim: int, size: int = QUERY_BLOCK) -> tuple[int, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """How many blocks the queries make, and (ids, vectors) of each, at most about size rows; one block at a time is on the driver."""
    q = queries.select(F.col("id").cast("long").alias("id"), "data").where(F.col("id").isNotNull() & (F.size("data") == dim) & ~F.exists("data", lambda e: e.isNull()))
    n = q.count()
    m = 1 if n <= size else -(-n * 5 // (size * 4))
    q = materialize(q, "queries") if m > 1 else q

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(m if n else 0):
            t = (q if m == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(m)) == i)).toArrow()
            if t.num_rows:
                yield t["id"].to_numpy(), kernels.matrix(t["data"], dim, np.float64)

    return m, blocks()


def by_blocks(src: DataFrame, queries: DataFrame, k: int, dim: int, scan: Callable[[Broadcast], Callable], apply: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """The best k per query of what scan finds in src, block of queries by block.

    A query is in one block, so blocks are finished separately: with several, src is written once and read per block, each block's result is
    written, and its broadcast is released, so that neither the driver's memory nor the plan grows with the queries.
    """
    spark = src.sparkSession
    m, blocks = query_blocks(queries, dim) if k > 0 else (0, iter(()))
    src = materialize(src, "searched") if m > 1 else src
    out = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        found = top_k(apply(src, scan(sent)), k)
        if m > 1:
            found = materialize(found, "found")
            sent.destroy()
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, distance double, rank int")


def best(ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest by (distance, id)."""
    if len(dist) > k:
        edge = np.partition(dist, k - 1)[k - 1]
        keep = np.nonzero(dist <= edge)[0]
    else:
        keep = np.arange(len(dist))
    return keep[np.lexsort((ids[keep], dist[keep]))[:k]]


def exact_block(qid, q, ids, x, k: int, metric: str, drop_self: bool):
    """For each query the best k of the rows of one batch: arrays (query id, id, distance)."""
    out_q, out_i, out_d = [], [], []
    step = max(1, 4_000_000 // max(1, len(ids)))
    for s in range(0, len(qid), step):
        approx = kernels.block(metric, q[s : s + step], x)
        if drop_self:
            approx[qid[s : s + step][:, None] == ids[None, :]] = np.inf
        kk = min(k, approx.shape[1])
        edge = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        row, col = np.nonzero((approx <= edge[:, None] + 1e-9) & np.isfinite(approx))
        d = kernels.rowwise(metric, q[s + row], x[col])
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(approx)))
        keep = np.arange(len(row)) - first[row] < k
        out_q.append(qid[s + row[keep]]), out_i.append(ids[col[keep]]), out_d.append(d[keep])
    cat = lambda p, t: np.concatenate(p) if p else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_i, np.int64), cat(out_d, np.float64)


def _best_of(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The best k of each query of (query id, id, distance)."""
    order = np.lexsort((found[1], found[2], found[0]))
    found = [c[order] for c in found]
    top = np.arange(len(order)) - np.searchsorted(found[0], found[0]) < k
    return [c[top] for c in found]


def knn(points: DataFrame, queries: DataFrame, k: int, dim: int, metric="cosine", where: Column | None = None, drop_self: bool = False) -> DataFrame:
    """query_id, id, distance, rank: the k nearest points of every query, exactly.

    points and queries have id and data; rows with a null id, a null element or another length than dim take no part.
    Repeated rows count as often as they stand. Empty tables and k <= 0 give no rows. metric is a name or a vectors.CustomMetric; a function of Columns without a kernel
    goes to knn_plan, an unknown name is a ValueError.
    """
    metric_of(metric)
    if not isinstance(metric, str) and not hasattr(metric, "kernel"):
        return knn_plan(points, queries, k, metric, where, drop_self)
    src = points if where is None else points.where(where)
    src = src.select(F.col("id").cast("long").alias("id"), "data").where(F.col("id").isNotNull() & (F.size("data") == dim) & ~F.exists("data", lambda e: e.isNull()))

    def scan(sent: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            kept = None  # the best so far, so that a task sends k rows per query, however many batches it reads
            for b in batches:
                if b.num_rows:
                    got = exact_block(qid, q, b.column(0).to_numpy(zero_copy_only=False), kernels.matrix(b.column(1), dim, np.float64), k, metric, drop_self)
                    kept = got if kept is None else _best_of([np.concatenate(c) for c in zip(kept, got)], k)
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in kept], ["query_id", "id", "distance"])

        return run

    return by_blocks(src, queries, k, dim, scan, lambda df, f: df.mapInArrow(f, FOUND))
