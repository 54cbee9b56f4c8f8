"""VectorIndex: points, their graph and removed ids as immutable DataFrames. Every change gives a new index; readers of the old one see no difference."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators import ann, graph
from nearfield.operators.knn import knn, knn_vector
from nearfield.operators.points import allocate_ids, latest, level, validate


@dataclass(frozen=True)
class IndexParams:
    """max_edges: cap of out-edges above layer 0, twice that on it. min_nn: least width of a search. max_candidates: width of construction."""

    max_edges: int = 16
    distribution_rate: float = 1 / math.log(16)
    min_nn: int = 5
    max_candidates: int = 1000
    collection_size: int = 65536
    random_seed: int = 31337

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class VectorIndex:
    """Points have label, id, data and any payload columns; labels and ids are unique. Distances are cosine unless said otherwise."""

    points: DataFrame
    dim: int
    metric: str = "cosine"
    params: IndexParams = IndexParams()
    removed: DataFrame | None = None
    bad_points: DataFrame | None = None
    nodes: DataFrame | None = None
    shards: int = 0

    @classmethod
    def empty(cls, spark, dim: int, metric: str = "cosine", params: IndexParams = IndexParams(), payload: str = "") -> VectorIndex:
        return cls(spark.createDataFrame([], "label string, id long, data array<float>" + payload), dim, metric, params, spark.createDataFrame([], "id long"), spark.createDataFrame([], "label string, reason string"))

    @property
    def spark(self):
        return self.points.sparkSession

    def _removed(self) -> DataFrame:
        return self.removed if self.removed is not None else self.spark.createDataFrame([], "id long")

    # changes
    def add(self, new: DataFrame, order: str | None = None) -> VectorIndex:
        """Insert or replace points by label (columns label, data, payload). Of rows with one label the last by `order` counts, else the greatest vector.

        A label that is known keeps its id; others get removed ids in ascending order, then new ones. Unusable vectors go to bad_points and
        don't touch a stored point of that label. A graph is kept: replaced points leave it, new ones are linked into their shards.
        """
        rows = new.drop("id").where(F.col("label").isNotNull())
        rows = latest(rows, "label", order or "data")
        good, bad = validate(rows, self.dim, zero_ok=self.metric not in ("cosine", "unit_cosine"))
        known = good.join(self.points.select("label", "id"), "label")
        fresh = good.join(self.points.select("label"), "label", "left_anti")
        used = self.points.select("id").unionByName(self._removed().select("id"))
        top = used.agg(F.max("id")).first()[0]
        given = allocate_ids(fresh, self._removed(), 0 if top is None else int(top) + 1)
        kept = self.points.join(known.select("label"), "label", "left_anti")
        points = kept.unionByName(known, allowMissingColumns=True).unionByName(given, allowMissingColumns=True)
        removed = self._removed().join(given.select("id"), "id", "left_anti")
        named = bad.select("label", "reason")
        nodes = self.nodes
        if nodes is not None:
            p = self.params
            changed = known.select("id", "label", "data").unionByName(given.select("id", "label", "data"))
            stale = ann.remove_nodes(nodes, known.select("id"), self.dim, self.metric, p.max_edges)
            nodes = ann.add_nodes(stale, changed, self.shards, self.dim, self._drawn(), self.metric, p.max_edges, p.max_candidates)
        return replace(self, points=points, removed=removed, bad_points=named if self.bad_points is None else self.bad_points.unionByName(named).distinct(), nodes=nodes)

    batch_add = add

    def mark_bad(self, labels: DataFrame, reason: str = "application") -> VectorIndex:
        """Record labels (column label) whose data couldn't be made into a vector. Stored points of those labels stay."""
        named = labels.select("label").where(F.col("label").isNotNull()).withColumn("reason", F.lit(reason))
        return replace(self, bad_points=named.distinct() if self.bad_points is None else self.bad_points.unionByName(named).distinct())

    def remove(self, gone: DataFrame) -> VectorIndex:
        """Without the points whose id (or label, if gone has only that) is in gone. Unknown and repeated ones do nothing; the last point may go too."""
        key = "id" if "id" in gone.columns else "label"
        keys = gone.select(key).where(F.col(key).isNotNull()).distinct()
        freed = self.points.join(keys, key, "left_semi").select(F.col("id").cast("long").alias("id"))
        nodes = ann.remove_nodes(self.nodes, freed, self.dim, self.metric, self.params.max_edges) if self.nodes is not None else None
        return replace(self, points=self.points.join(keys, key, "left_anti"), removed=self._removed().unionByName(freed).distinct(), nodes=nodes)

    # queries
    def query(self, vector: list[float], k: int, where: Column | None = None, layer: int = 0) -> DataFrame:
        """The k points nearest to a vector, exactly, with all their columns and distance."""
        return knn_vector(self._layer(layer), vector, k, self.metric, where)

    def query_batch(self, queries: DataFrame, k: int, where: Column | None = None, layer: int = 0, drop_self: bool = False) -> DataFrame:
        """query_id, id, distance, rank for a table of queries (id, data), exactly."""
        return knn(self._layer(layer), queries, k, self.dim, self.metric, where, drop_self)

    def query_approximate(self, queries: DataFrame, k: int, where: Column | None = None, layer: int = 0, drop_self: bool = False) -> DataFrame:
        """The same by the sharded graph, which build() makes. The filter may use label, id and data."""
        if self.nodes is None:
            raise ValueError("the index has no graph; call build() first")
        return ann.search_graph(self.nodes, queries, k, self.dim, self.metric, self.params.max_edges, self.params.min_nn, layer, drop_self, where)

    def _drawn(self) -> Column:
        return level(F.col("label"), self.params.random_seed, self.params.distribution_rate)

    def levels(self) -> DataFrame:
        """id and top layer of every point."""
        return self.points.select("id", self._drawn().alias("level"))

    def entry_point(self) -> DataFrame:
        """id, level of the point with the most layers; no rows for an empty index."""
        return graph.entry_point(self.levels())

    def _layer(self, layer: int) -> DataFrame:
        if layer <= 0:
            return self.points
        drawn = self._drawn()
        top = self.points.agg(F.max(drawn)).first()[0]
        if top is None or layer > top:
            raise ValueError(f"layer {layer} doesn't exist; the top layer is {top}")
        return self.points.where(drawn >= layer)

    # graph
    def build(self, shards: int | None = None) -> VectorIndex:
        """With the layered graph, in shards."""
        p = self.params
        n = shards or ann.shard_count(self.count())
        return replace(self, nodes=ann.build_graph(self.points, n, self.dim, self._drawn(), self.metric, p.max_edges, p.max_candidates), shards=n)

    def _edges(self) -> DataFrame:
        edges = "id long, out_edges array<array<long>>, in_edges array<array<long>>"
        return self.spark.createDataFrame([], edges) if self.nodes is None else self.nodes.select("id", "out_edges", "in_edges")

    def info(self) -> DataFrame:
        """Nodes and degrees per layer; no rows without a graph."""
        return graph.layer_info(self._edges())

    def graph_layer(self, layer: int) -> DataFrame:
        """layer, id, neighbour of one layer; no rows without a graph or above its top layer."""
        return graph.layer_adjacency(self._edges(), layer)

    # inspection
    def count(self) -> int:
        return self.points.count()

    def items(self) -> DataFrame:
        return self.points

    def same_as(self, other: VectorIndex) -> bool:
        """Same parameters, dimension, metric, points (all columns), removed ids and graph (edges of every node in order), in any order of rows."""
        if (self.params, self.dim, self.metric) != (other.params, other.dim, other.metric) or sorted(self.points.columns) != sorted(other.points.columns):
            return False
        tables = ((self.points, other.points.select(*self.points.columns)), (self._removed(), other._removed()), (self._edges(), other._edges()))
        return all(sum(graph.difference(a, b).first()) == 0 for a, b in tables)
