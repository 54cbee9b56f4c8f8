"""Queries for points, functions, neighbours, mutation, graphs and storage, each with the SQL it must agree with.

Most run over `embeddings` (vec_id, embedding, label as a category), those on dirty data over `points` and the store tables. Batches of queries
are all rows whose id is divisible by 20, against all rows. Distances are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.index import VectorIndex
from nearfield.operators import graph as G
from nearfield.operators import points as P
from nearfield.operators.knn import knn, knn_plan, knn_vector
from nearfield.plans.tables import table
from nearfield.session import work_root
from nearfield.sources.store import IndexStore, slices

DIM = 64
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as points: id, label, category, data."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("label"), F.col("label").alias("category"), F.col("embedding").alias("data"))


def usable(spark: SparkSession, d: str) -> DataFrame:
    return P.current_usable(table(spark, d, "points"), DIM).withColumn("id", F.col("id").cast("long"))


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the point with the least id, the query of the single-query plans."""
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


def rounded(df: DataFrame) -> DataFrame:
    """query_id, id, distance (6 places), rank as BIGINT."""
    return df.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def every20(points: DataFrame) -> DataFrame:
    return points.where("id % 20 = 0")


# SQL fragments
def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"(1 - {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


def _sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


_E = "e AS (SELECT vec_id AS id, embedding AS data, label AS category FROM embeddings)"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS rn FROM points) WHERE rn = 1)"
_OK = "len(data) = 64 AND len(list_filter(data, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(data, lambda x: x <> 0)) > 0"
_U = f"{_LATEST}, u AS (SELECT id::BIGINT AS id, label, data, created_time FROM latest WHERE {_OK})"


def _knn_sql(ctes: str, points: str, queries: str, k: int, dist=_cos, drop_self: bool = False) -> str:
    norm = "sqrt(list_sum(list_transform(data, lambda x: x::DOUBLE * x::DOUBLE)))"
    if dist is _cos:  # lengths once per row
        body = f"1 - {_dot('q.data', 'p.data')} / (q.n * p.n)"
        src, asks = f"(SELECT id, data, {norm} AS n FROM {points})", f"(SELECT id, data, {norm} AS n FROM {queries})"
    else:
        body, src, asks = dist("q.data", "p.data"), f"(SELECT id, data FROM {points})", f"(SELECT id, data FROM {queries})"
    other = " WHERE p.id <> q.id" if drop_self else ""
    return f"""WITH {ctes}, d AS (SELECT q.id AS query_id, p.id AS id, {body} AS distance FROM {src} p CROSS JOIN {asks} q{other}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id::BIGINT AS query_id, id::BIGINT AS id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= {k}"""


_Q20 = "(SELECT * FROM e WHERE id % 20 = 0)"


# sources
@query("SELECT vec_id AS id, label AS category, len(embedding)::BIGINT AS dim FROM embeddings")
def scan_points(spark, d):
    return embeddings(spark, d).select("id", "category", F.size("data").cast("long").alias("dim"))


@query()
def random_points(spark, d):
    return P.random_points(spark, 1000, DIM, seed=3).select("label", F.col("id").cast("long").alias("id"), F.size("data").alias("dim"))


@query("SELECT index_name, max_edges::BIGINT AS max_edges, distribution_rate, min_nn::BIGINT AS min_nn, max_candidates::BIGINT AS max_candidates, random_seed::BIGINT AS random_seed, entry_point::BIGINT AS entry_point FROM store_config")
def scan_config(spark, d):
    big = [F.col(c).cast("long").alias(c) for c in ("max_edges", "min_nn", "max_candidates", "random_seed", "entry_point")]
    return table(spark, d, "store_config").select("index_name", "distribution_rate", *big)


# functions
@query(f"SELECT vec_id AS id, round(sqrt({_dot('embedding', 'embedding')}), 6) + 0.0 AS magnitude FROM embeddings")
def vec_magnitude(spark, d):
    return embeddings(spark, d).select("id", F.round(V.magnitude(F.col("data")), 6).alias("magnitude"))


@query(f"WITH n AS (SELECT vec_id, embedding, sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings) SELECT vec_id AS id, unnest(range(len(embedding)))::BIGINT AS pos, round(unnest(embedding)::DOUBLE / n, 6) + 0.0 AS x FROM n")
def vec_normalize(spark, d):
    return embeddings(spark, d).select("id", F.posexplode(V.normalize(F.col("data"))).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


def _distance_query(name: str, sql: str) -> None:
    def run(spark, d):
        q = F.array(*[F.lit(v).cast("float") for v in first_vector(spark, d)])
        return embeddings(spark, d).select("id", (F.round(V.METRICS[name](F.col("data"), q), 6) + 0.0).alias("distance"))

    run.__name__ = f"dist_{name}"
    query(f"WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round({sql}, 6) + 0.0 AS distance FROM embeddings, q")(run)


for _name, _sql in (("cosine", _cos("embedding", "v")), ("unit_cosine", f"(1 - {_dot('embedding', 'v')})"), ("sqeuclidean", _sq("embedding", "v")), ("euclidean", f"sqrt({_sq('embedding', 'v')})")):
    _distance_query(_name, _sql)


@query("""SELECT a.label, bool_and(a.id IS NOT DISTINCT FROM b.id AND a.data IS NOT DISTINCT FROM b.data) AS same FROM (SELECT DISTINCT label, id, data FROM store_points) a
JOIN (SELECT DISTINCT label, id, data FROM store_points_copy) b ON a.label = b.label GROUP BY 1""")
def point_equality(spark, d):
    a, b = (table(spark, d, t).select("label", F.col("id").alias(f"id_{x}"), F.col("data").alias(f"data_{x}")).distinct() for t, x in (("store_points", "a"), ("store_points_copy", "b")))
    same = V.same_point(F.col("label"), F.col("id_a"), F.col("data_a"), F.col("label"), F.col("id_b"), F.col("data_b"))
    return a.join(b, "label").groupBy("label").agg(F.bool_and(same).alias("same"))


# neighbours
_ONE = f"WITH {_E}, q AS (SELECT data AS v FROM e ORDER BY id LIMIT 1) SELECT id, round({{dist}}, 6) + 0.0 AS distance FROM e, q {{where}} ORDER BY {{dist}}, id LIMIT {{k}}"


def _single(spark, d, k, metric="cosine", where=None):
    return knn_vector(embeddings(spark, d), first_vector(spark, d), k, metric, where).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(_ONE.format(dist=_cos("data", "v"), where="", k=10))
def knn_single(spark, d):
    return _single(spark, d, 10)


@query(f"WITH {_E} SELECT id, round({_cos('data', 'list_transform(range(64), lambda i: 1.0::DOUBLE)')}, 6) + 0.0 AS distance FROM e ORDER BY {_cos('data', 'list_transform(range(64), lambda i: 1.0::DOUBLE)')}, id LIMIT 10")
def knn_by_vector(spark, d):
    return knn_vector(embeddings(spark, d), [1.0] * DIM, 10).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(_ONE.format(dist=_cos("data", "v"), where="WHERE category = 3", k=10))
def knn_filtered(spark, d):
    return _single(spark, d, 10, where=F.col("category") == 3)


@query(_ONE.format(dist=_cos("data", "v"), where="WHERE category = -1", k=10))
def knn_filter_none(spark, d):
    return _single(spark, d, 10, where=F.col("category") == -1)


@query(_ONE.format(dist=_cos("data", "v"), where="", k=2))
def knn_min_nn(spark, d):
    return _single(spark, d, 2)


@query(_ONE.format(dist=_cos("data", "v"), where="", k=1_000_000))
def knn_k_exceeds_n(spark, d):
    return _single(spark, d, 1_000_000)


@query(_ONE.format(dist=_sq("data", "v"), where="", k=10))
def knn_single_sqeuclidean(spark, d):
    return _single(spark, d, 10, "sqeuclidean")


@query(_knn_sql(_E, "e", _Q20, 10))
def knn_batch(spark, d):
    e = embeddings(spark, d)
    return rounded(knn(e, every20(e), 10, DIM))


@query(_knn_sql(_E, "e", _Q20, 10))
def knn_batch_plan(spark, d):
    """knn_batch as one Catalyst plan without Python."""
    e = embeddings(spark, d)
    return rounded(knn_plan(e, every20(e), 10))


@query(_knn_sql(_E, "e", _Q20, 10, lambda a, b: f"sqrt({_sq(a, b)})"))
def knn_euclidean(spark, d):
    e = embeddings(spark, d)
    return rounded(knn(e, every20(e), 10, DIM, "euclidean"))


@query(_knn_sql(_E, "(SELECT * FROM e WHERE category = 3)", _Q20, 10))
def knn_batch_filtered(spark, d):
    e = embeddings(spark, d)
    return rounded(knn(e, every20(e), 10, DIM, where=F.col("category") == 3))


@query(_knn_sql(_U, "u", "(SELECT * FROM u WHERE id % 20 = 0)", 10, drop_self=True))
def knn_points(spark, d):
    """Over the current usable points."""
    u = usable(spark, d)
    return rounded(knn(u, every20(u), 10, DIM, drop_self=True))


@query(_knn_sql(_U, "(SELECT * FROM u WHERE created_time >= TIMESTAMPTZ '2024-06-01 00:00:00+00')", "(SELECT * FROM u WHERE id % 20 = 0)", 10))
def timed_points_knn(spark, d):
    """Points with a payload column, filtered by it. The filter is on the current row, so it stays behind the aggregate."""
    latest = P.latest(table(spark, d, "points").select("label", "id", "data", "created_time", "seq"))
    u = latest.where(V.unusable_reason(F.col("data"), DIM).isNull())
    late = F.col("created_time") >= F.lit("2024-06-01 00:00:00+00:00").cast("timestamp")
    return rounded(knn(u, every20(usable(spark, d)), 10, DIM, where=late))


@query(_knn_sql(_E, "e", _Q20, 10))
def knn_sharded_merge(spark, d):
    """Best 10 per category shard, then of all shards: the same as without shards."""
    from functools import reduce

    from nearfield.operators.knn import top_k

    e = embeddings(spark, d)
    shards = [r["category"] for r in e.select("category").distinct().collect()]  # a category of few values
    parts = [knn(e.where(F.col("category") == s), every20(e), 10, DIM).drop("rank") for s in sorted(shards)]
    return rounded(top_k(reduce(DataFrame.unionAll, parts), 10))


# mutation
@query(_knn_sql(_U + ", kept AS (SELECT * FROM u WHERE id NOT IN (SELECT index_id FROM removed_indexes WHERE index_id IS NOT NULL))", "kept", "(SELECT * FROM u WHERE id % 20 = 0)", 10))
def knn_after_remove(spark, d):
    u = usable(spark, d)
    kept = P.remove(u, table(spark, d, "removed_indexes").select(F.col("index_id").cast("long").alias("id")))
    return rounded(knn(kept, every20(u), 10, DIM))


_MERGED = f"""c AS (SELECT DISTINCT label, id, data FROM store_points_copy), s AS (SELECT DISTINCT label, id, data FROM store_points),
m AS (SELECT label, id::BIGINT AS id, data FROM s WHERE label NOT IN (SELECT label FROM c) UNION ALL SELECT label, id::BIGINT, data FROM c), mu AS (SELECT * FROM m WHERE {_OK})"""


@query(_knn_sql(_MERGED, "mu", "(SELECT * FROM mu WHERE id % 20 = 0)", 10))
def knn_after_upsert(spark, d):
    """store_points with the rows of its copy put over them."""
    s, c = (table(spark, d, t).select("label", F.col("id").cast("long").alias("id"), "data").distinct() for t in ("store_points", "store_points_copy"))
    good, _ = P.validate(P.upsert(s, c), DIM)
    return rounded(knn(good, every20(good), 10, DIM))


@query(f"WITH {_LATEST} SELECT label, id::BIGINT AS id, seq, index_name, len(data)::BIGINT AS dim FROM latest")
def upsert_latest_wins(spark, d):
    return P.latest(table(spark, d, "points")).select("label", F.col("id").cast("long").alias("id"), "seq", "index_name", F.size("data").cast("long").alias("dim"))


@query(f"""WITH {_LATEST} SELECT label, CASE WHEN data IS NULL THEN 'null' WHEN len(data) = 0 THEN 'empty' WHEN len(data) <> 64 THEN 'dimension' WHEN len(list_filter(data, lambda x: x IS NULL)) > 0 THEN 'null_element'
WHEN len(list_filter(data, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite' ELSE 'zero' END AS reason FROM latest WHERE data IS NULL OR NOT ({_OK})""")
def bad_points(spark, d):
    return P.validate(P.latest(table(spark, d, "points")), DIM)[1].select("label", "reason")


@query(f"WITH {_U} SELECT count(*) AS n FROM u")
def count_items(spark, d):
    return usable(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {_U} SELECT id, label FROM u WHERE id NOT IN (SELECT index_id FROM removed_indexes WHERE index_id IS NOT NULL)")
def items_after_remove(spark, d):
    return P.remove(usable(spark, d), table(spark, d, "removed_indexes").select(F.col("index_id").cast("long").alias("id"))).select("id", "label")


@query("""WITH n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM (SELECT DISTINCT label FROM store_points_copy WHERE label NOT IN (SELECT label FROM store_points))),
f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT index_id AS id FROM removed_indexes WHERE index_id IS NOT NULL)),
t AS (SELECT (SELECT max(id) FROM store_points) + 1 AS next, (SELECT count(*) FROM f) AS free)
SELECT n.label, coalesce(f.id, t.next + n.pos - t.free)::BIGINT AS id FROM n CROSS JOIN t LEFT JOIN f ON f.pos = n.pos""")
def id_allocation(spark, d):
    """Ids for the labels only the copy has: removed ids in ascending order, then new ones."""
    s, c = table(spark, d, "store_points"), table(spark, d, "store_points_copy")
    new = c.select("label").distinct().join(s.select("label"), "label", "left_anti")
    top = s.agg(F.max("id")).first()[0]
    return P.allocate_ids(new, table(spark, d, "removed_indexes").select(F.col("index_id").alias("id")), top + 1).select("label", "id")


# layers and graphs
_LEVEL = "floor(-ln((('0x' || substr(md5('31337-' || vec_id::VARCHAR), 1, 8))::BIGINT + 1.0::DOUBLE) / 4294967297.0::DOUBLE) * (1 / ln(16::DOUBLE)))::BIGINT"


def _levels(spark, d):
    return VectorIndex(embeddings(spark, d), DIM).levels().select("id", F.col("level").cast("long").alias("level"))


@query(f"SELECT vec_id AS id, {_LEVEL} AS level FROM embeddings")
def layer_assignment(spark, d):
    return _levels(spark, d).select("id", "level")


@query(f"WITH l AS (SELECT {_LEVEL} AS level FROM embeddings) SELECT layer::BIGINT AS layer, count(*) AS n FROM l, range(0, 64) r(layer) WHERE layer <= level GROUP BY 1")
def layer_histogram(spark, d):
    """Nodes per layer; a node is in all layers up to its level."""
    layers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("level"))).alias("layer")
    return _levels(spark, d).select(layers).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"SELECT vec_id AS id, {_LEVEL} AS level FROM embeddings ORDER BY 2 DESC, 1 LIMIT 1")
def entry_point(spark, d):
    return VectorIndex(embeddings(spark, d), DIM).entry_point().select("id", F.col("level").cast("long").alias("level"))


@query(_knn_sql(f"{_E}, up AS (SELECT vec_id AS id, embedding AS data FROM embeddings WHERE {_LEVEL} >= 1)", "up", _Q20, 10))
def knn_layer(spark, d):
    """Neighbours among the nodes of layer 1."""
    e = embeddings(spark, d)
    return rounded(VectorIndex(e, DIM).query_batch(every20(e), 10, layer=1))


_EDGES = _knn_sql(_E, "e", "e", 16, drop_self=True)


@query(f"SELECT query_id AS src, id AS dst, distance, rank FROM ({_EDGES})")
def graph_edges_exact(spark, d):
    return G.exact_edges(embeddings(spark, d), 16, DIM).select("src", "dst", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT id, query_id AS in_id FROM ({_EDGES})")
def graph_in_edges(spark, d):
    return G.reverse_edges(G.exact_edges(embeddings(spark, d), 16, DIM))


_LIVE = "live AS (SELECT DISTINCT id, out_edges, in_edges, saved_at FROM store_nodes WHERE id NOT IN (SELECT index_id FROM removed_indexes WHERE index_id IS NOT NULL))"
_LAYERS = f"""WITH {_LIVE}, r AS (SELECT l.id, layer, coalesce(out_edges[layer + 1], []) AS o, coalesce(in_edges[layer + 1], []) AS i FROM live l, range(0, 64) x(layer)
WHERE layer < greatest(coalesce(len(out_edges), 0), coalesce(len(in_edges), 0)))"""


def _live_nodes(spark, d):
    return G.live(table(spark, d, "store_nodes").select("id", "out_edges", "in_edges", "saved_at"), table(spark, d, "removed_indexes"), "index_id")


@query(f"{_LAYERS} SELECT layer::BIGINT AS layer, count(*) AS nodes, min(len(o))::BIGINT AS min_out, max(len(o))::BIGINT AS max_out, round(avg(len(o)), 6) AS avg_out, min(len(i))::BIGINT AS min_in, max(len(i))::BIGINT AS max_in, round(avg(len(i)), 6) AS avg_in FROM r GROUP BY 1")
def graph_layer_info(spark, d):
    """Nodes and degrees per layer over the live nodes of the store."""
    info = G.layer_info(_live_nodes(spark, d))
    big = [F.col(c).cast("long").alias(c) for c in ("layer", "min_out", "max_out", "min_in", "max_in")]
    return info.select("nodes", *big, *[F.round(c, 6).alias(c) for c in ("avg_out", "avg_in")])


@query(f"{_LAYERS} SELECT layer::BIGINT AS layer, id::BIGINT AS id, unnest(o)::BIGINT AS neighbour FROM r")
def graph_layer_adjacency(spark, d):
    return G.layer_adjacency(_live_nodes(spark, d)).select(*[F.col(c).cast("long").alias(c) for c in ("layer", "id", "neighbour")])


_CAND = f"""WITH {_E}, d AS (SELECT q.id AS query_id, p.id AS id, p.data AS data, 1 - {_dot('q.data', 'p.data')} AS dist FROM e p CROSS JOIN {_Q20} q WHERE p.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d),
c AS (SELECT query_id, list([{{'dist': dist, 'id': id, 'data': data}}] ORDER BY dist, id) AS cs FROM r WHERE rank <= 32 GROUP BY 1),
k AS (SELECT query_id, list_reduce(cs, lambda acc, x: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda y: 1 - {_dot('y.data', 'x[1].data')} <= x[1].dist)) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM c)
SELECT query_id, unnest(list_transform(kept, lambda y: y.id)) AS id, unnest(range(len(kept)))::BIGINT AS pos FROM k"""


@query(_CAND)
def heuristic_select(spark, d):
    """The diverse 8 of the 32 nearest neighbours of every query."""
    e = embeddings(spark, d)
    near = knn(e, every20(e), 32, DIM, "unit_cosine", drop_self=True).join(e.select("id", "data"), "id")
    exact = near.join(every20(e).select(F.col("id").alias("query_id"), F.col("data").alias("q")), "query_id").withColumn("distance", V.unit_cosine(F.col("q"), F.col("data")))
    return G.select_diverse(exact.select("query_id", "id", "distance", "data"), 8, "unit_cosine").select("query_id", "id", F.col("pos").cast("long").alias("pos"))


@query("""WITH a AS (SELECT DISTINCT id, out_edges, in_edges FROM store_nodes), b AS (SELECT DISTINCT id, out_edges, in_edges FROM store_nodes_copy)
SELECT coalesce(a.id, b.id)::BIGINT AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.out_edges IS DISTINCT FROM b.out_edges OR a.in_edges IS DISTINCT FROM b.in_edges""")
def dirty_nodes(spark, d):
    """Nodes whose edges changed from the store to its copy."""
    a, b = (table(spark, d, t).select("id", "out_edges", "in_edges") for t in ("store_nodes", "store_nodes_copy"))
    return G.changed_nodes(a, b).select(F.col("id").cast("long").alias("id"), "change")


# storage
@query(f"WITH {_U}, n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos FROM u) SELECT (pos // 1000 + 1)::BIGINT AS slice_no, count(*) AS n_rows FROM n GROUP BY 1")
def slice_assignment(spark, d):
    return slices(usable(spark, d), 1000)


def _stored(spark, d) -> tuple[IndexStore, str]:
    store = IndexStore(spark, f"{work_root(spark)}/stores", uuid.uuid4().hex)
    e = embeddings(spark, d)
    store.save("embeddings", VectorIndex(e, DIM), slice_rows=300)
    return store, "embeddings"


@query(f"SELECT vec_id AS id, vec_id::VARCHAR AS label, label AS category, len(embedding)::BIGINT AS dim, round({_dot('embedding', 'embedding')}, 6) + 0.0 AS squared FROM embeddings")
def snapshot_roundtrip(spark, d):
    """Written in slices to a named store and read back."""
    store, name = _stored(spark, d)
    return store.load(name).items().select("id", "label", "category", F.size("data").cast("long").alias("dim"), F.round(V.squared_norm(F.col("data")), 6).alias("squared"))


@query("SELECT count(*) AS n FROM embeddings")
def node_count(spark, d):
    store, name = _stored(spark, d)
    n = store.node_count(name)
    store.drop(name)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("""SELECT (SELECT count(*) FROM (SELECT id, out_edges, in_edges FROM store_nodes EXCEPT ALL SELECT id, out_edges, in_edges FROM store_nodes_copy)) AS only_first,
(SELECT count(*) FROM (SELECT id, out_edges, in_edges FROM store_nodes_copy EXCEPT ALL SELECT id, out_edges, in_edges FROM store_nodes)) AS only_second""")
def index_equality(spark, d):
    """Rows by which the stored graph and its copy differ; both 0 if they are equal."""
    a, b = (table(spark, d, t).select("id", "out_edges", "in_edges") for t in ("store_nodes", "store_nodes_copy"))
    return G.difference(a, b)


# approximate search, which SQL can't state
@query()
def ann_hnsw_knn(spark, d):
    e = embeddings(spark, d)
    return rounded(VectorIndex(e, DIM).build(shards=2).query_approximate(every20(e), 10))


@query()
def ann_recall(spark, d):
    """Share of the exact 10 neighbours that the graph search finds."""
    e = embeddings(spark, d)
    found = VectorIndex(e, DIM).build(shards=2).query_approximate(every20(e), 10).select("query_id", "id").withColumn("hit", F.lit(1))
    return knn(e, every20(e), 10, DIM).join(found, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))


@query()
def ann_after_remove(spark, d):
    """Graph search after the points of category 3 were removed and their neighbours rewired."""
    e = embeddings(spark, d)
    return rounded(VectorIndex(e, DIM).build(shards=2).remove(e.where("category = 3").select("id")).query_approximate(every20(e), 10))


@query()
def ann_layer_info(spark, d):
    return VectorIndex(embeddings(spark, d), DIM).build(shards=2).info()
