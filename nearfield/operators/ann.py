"""Sharded approximate search: a graph per shard, built and searched in Arrow batches, the best k of all shards merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.operators import hnsw
from nearfield.operators.knn import FOUND, by_blocks

NODES = "shard int, id long, label string, data array<float>, out_edges array<array<long>>, in_edges array<array<long>>"
#: Points of one shard, about: bounds the memory and time of a task.
SHARD_ROWS = 20_000


def shard_count(n: int, rows: int = SHARD_ROWS) -> int:
    return max(1, -(-n // rows))


def build_graph(points: DataFrame, shards: int, dim: int, level: Column, metric: str = "cosine", max_edges: int = 16, max_candidates: int = 1000) -> DataFrame:
    """Node table (see NODES) of points (id, label, data). A point's shard is a hash of its label, so it stays there over versions."""
    src = points.select(F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("data").cast("array<float>").alias("data"), level.alias("level"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        g = hnsw.build(t["id"].to_numpy(), kernels.matrix(t["data"], dim, np.float64), t["level"].to_numpy().astype(np.int64), metric, max_edges, max_candidates)
        rows = hnsw.to_rows(g)
        nested = pa.list_(pa.list_(pa.int64()))
        return pa.table({"shard": t["shard"], "id": t["id"], "label": t["label"], "data": t["data"], "out_edges": pa.array([r[1] for r in rows], nested), "in_edges": pa.array([r[2] for r in rows], nested)})

    return src.groupBy("shard").applyInArrow(run, NODES)


def add_nodes(nodes: DataFrame, points: DataFrame, shards: int, dim: int, level: Column, metric="cosine", max_edges: int = 16, max_candidates: int = 1000) -> DataFrame:
    """Nodes with further points (id, label, data; ids that are no node's yet), linked into the shards of their labels. Shards that get none come back as they are."""
    key = F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("array<array<long>>")
    fresh = points.select(key.alias("shard"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("data").cast("array<float>").alias("data"), none.alias("out_edges"), none.alias("in_edges"), level.cast("int").alias("_new"))
    both = nodes.withColumn("_new", F.lit(None).cast("int")).unionByName(fresh)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        names = ["shard", "id", "label", "data", "out_edges", "in_edges"]
        new = t["_new"].is_valid().to_numpy()
        if not new.any():
            return t.select(names)
        old, more = t.filter(pa.array(~new)), t.filter(pa.array(new))
        rows = hnsw.to_rows(hnsw.insert(_graph(old, dim, metric, max_edges), more["id"].to_numpy(), kernels.matrix(more["data"], dim, np.float64), more["_new"].to_numpy().astype(np.int64), max_candidates))
        nested = pa.list_(pa.list_(pa.int64()))
        return t.select(names[:4]).append_column("out_edges", pa.array([r[1] for r in rows], nested)).append_column("in_edges", pa.array([r[2] for r in rows], nested))

    return both.groupBy("shard").applyInArrow(run, NODES)


def _graph(t: pa.Table, dim: int, metric: str, max_edges: int) -> hnsw.ShardGraph:
    return hnsw.from_rows(t["id"].to_numpy(), kernels.matrix(t["data"], dim, np.float64), t["out_edges"].to_pylist(), metric, max_edges)


def search_graph(nodes: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "cosine", max_edges: int = 16, min_nn: int = 5, layer: int = 0, drop_self: bool = False, where: Column | None = None) -> DataFrame:
    """query_id, id, distance, rank by beam search in every shard. Where a shard returns too few rows that pass the filter, it is searched exactly, so a
    selective filter loses nothing."""
    src = nodes.withColumn("_ok", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    scan = lambda sent: _searcher(sent, k, dim, metric, max_edges, min_nn, layer, drop_self)
    return by_blocks(src, queries, k, dim, scan, lambda df, f: df.groupBy("shard").applyInArrow(f, FOUND))


def _searcher(sent, k: int, dim: int, metric: str, max_edges: int, min_nn: int, layer: int, drop_self: bool):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        qid, q = sent.value
        t = t.combine_chunks()
        g = _graph(t, dim, metric, max_edges)
        ok = t["_ok"].to_numpy(zero_copy_only=False).astype(bool)
        some = None if ok.all() else ok
        in_layer = (g.level >= layer) & ok
        rows = []
        for i, v in zip(qid.tolist(), q) if layer < len(g.out) else ():
            got = [(d, int(g.ids[r])) for d, r in hnsw.search(g, v, k + drop_self, min_nn, layer, some)]
            got = [x for x in got if not (drop_self and x[1] == i)][:k]
            if some is not None and len(got) < min(k, int(in_layer.sum())):
                at = np.nonzero(in_layer & ~(drop_self & (g.ids == i)))[0]
                d = kernels.block(metric, v[None], g.x[at])[0]
                got = sorted(zip(d.tolist(), g.ids[at].tolist()))[:k]
            rows += [(i, j, d) for d, j in got]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})

    return run


def remove_nodes(nodes: DataFrame, gone: DataFrame, dim: int, metric: str = "cosine", max_edges: int = 16) -> DataFrame:
    """Nodes without the ids in gone, their neighbours rewired. Shards that lose nothing come back as they are; unknown ids do nothing."""
    marked = nodes.join(gone.select(F.col("id").cast("long").alias("id")).distinct().withColumn("_gone", F.lit(True)), "id", "left")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        names = ["shard", "id", "label", "data", "out_edges", "in_edges"]
        dead = t["_gone"].is_valid().to_numpy()
        if not dead.any():
            return t.select(names)
        rows = hnsw.to_rows(hnsw.remove(_graph(t, dim, metric, max_edges), np.nonzero(dead)[0]))
        kept = t.filter(pa.array(~dead)).select(names[:4])
        nested = pa.list_(pa.list_(pa.int64()))
        return kept.append_column("out_edges", pa.array([r[1] for r in rows], nested)).append_column("in_edges", pa.array([r[2] for r in rows], nested))

    return marked.groupBy("shard").applyInArrow(run, NODES)
