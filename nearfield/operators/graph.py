"""Proximity graphs as tables: exact edges, diverse neighbour selection, layers, degrees, entry point, changes between versions.

Nodes are rows (id, out_edges, in_edges) with one inner list of ids per layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import metric as metric_of
from nearfield.operators.knn import knn

FIELDS = ("out_edges", "in_edges")


def exact_edges(points: DataFrame, k: int, dim: int, metric: str = "cosine") -> DataFrame:
    """src, dst, distance, rank: the k exact neighbours of every point."""
    near = knn(points, points, k, dim, metric, drop_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance", "rank")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """id, in_id: the mirror of the edges, a row per edge, so that a hub is no long list."""
    return edges.select(F.col("dst").alias("id"), F.col("src").alias("in_id"))


def per_layer(nodes: DataFrame) -> DataFrame:
    """id, layer, out_list, in_list: a row per node and layer, from either list's length. Null lists count as empty."""
    empty = F.array().cast("array<array<int>>")
    zipped = F.arrays_zip(F.coalesce("out_edges", empty).alias("o"), F.coalesce("in_edges", empty).alias("i"))
    none = F.array().cast("array<int>")
    return nodes.select("id", F.posexplode(zipped).alias("layer", "e")).select("id", "layer", F.coalesce("e.o", none).alias("out_list"), F.coalesce("e.i", none).alias("in_list"))


def live(nodes: DataFrame, removed: DataFrame | None, key: str = "id") -> DataFrame:
    """Distinct nodes that aren't in removed."""
    nodes = nodes.distinct()
    return nodes if removed is None else nodes.join(removed.select(F.col(key).alias("id")).where("id is not null").distinct(), "id", "left_anti")


def layer_info(nodes: DataFrame) -> DataFrame:
    """layer, nodes, and least, greatest and mean out- and in-degree per layer. No nodes: no rows."""
    degrees = per_layer(nodes).select("layer", F.size("out_list").alias("o"), F.size("in_list").alias("i"))
    return degrees.groupBy("layer").agg(
        F.count("*").alias("nodes"), F.min("o").alias("min_out"), F.max("o").alias("max_out"), F.avg("o").alias("avg_out"), F.min("i").alias("min_in"), F.max("i").alias("max_in"), F.avg("i").alias("avg_in")
    )


def layer_adjacency(nodes: DataFrame, layer: int | None = None) -> DataFrame:
    """layer, id, neighbour: the out-edges of one layer, or of all. A layer that no node has gives no rows."""
    rows = per_layer(nodes)
    rows = rows if layer is None else rows.where(F.col("layer") == layer)
    return rows.select("layer", "id", F.explode("out_list").alias("neighbour"))


def select_diverse(candidates: DataFrame, keep: int, metric="cosine") -> DataFrame:
    """query_id, id, distance, pos: of each query's candidates (query_id, id, distance, data), nearest first, those that are nearer to
    the query than to any candidate kept before, at most keep; all of them where there are fewer than keep.

    Candidate lists are bounded by whoever made them (k of a neighbour query). One aggregate expression, no Python.
    """
    dist = metric_of(metric)
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "data"))).alias("cs"))
    start = F.slice("cs", 1, 1)

    def step(kept: Column, c: Column) -> Column:
        fits = (F.size(kept) < keep) & F.forall(kept, lambda r: dist(r["data"], c["data"]) > c["distance"])
        return F.when(fits, F.concat(kept, F.array(c))).otherwise(kept)

    pruned = F.when(F.size("cs") < keep, F.col("cs")).otherwise(F.aggregate(F.slice("cs", 2, F.size("cs")), start, step))
    return lists.select("query_id", F.posexplode(pruned).alias("pos", "c")).select("query_id", "c.id", "c.distance", "pos")


def entry_point(levels: DataFrame) -> DataFrame:
    """id, level of the node with the most layers; the smaller id of several. No nodes: no rows."""
    return levels.groupBy().agg(F.max_by(F.struct("id", "level"), F.struct("level", -F.col("id"))).alias("e")).where("e is not null").select("e.id", "e.level")


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change: nodes added, removed, or whose edges differ between two versions. Repeated rows count once.

    Of an id with several different rows the sets of rows are compared, by their number, their sum of hashes, and the least and the greatest.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*FIELDS)
        rows = df.select("id", *FIELDS).distinct().groupBy("id")
        return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*FIELDS).cast("decimal(38,0)")).alias("h"), F.min(row).alias("lo"), F.max(row).alias("hi")).select("id", F.struct("n", "h", "lo", "hi").alias(name))

    both = side(before, "b").join(side(after, "a"), "id", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("id", change.alias("change")).where("change is not null")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only a has and how many only b has, counting repeats."""
    only = a.exceptAll(b).select(F.lit(1).alias("f"), F.lit(0).alias("s")).unionAll(b.exceptAll(a).select(F.lit(0), F.lit(1)))
    return only.agg(F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("only_first"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("only_second"))
