"""The queries of the training-data operators, and SQL where SQL can state them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.forest import similar_vectors
from nearfield.llm.leakage import find_leaks, without_leaks
from nearfield.llm.packing import CAPACITY, container_fill, pack_documents
from nearfield.llm.peaks import CELL_ROWS, SAMPLE_ROWS, density_peaks, describe_groups, large_groups, linked_groups
from nearfield.llm.residue import find_residue
from nearfield.llm.subset import represented, varied_subset
from nearfield.operators.points import current_packed, current_usable
from nearfield.plans.tables import table

DIM = 64


def _points(spark: SparkSession, d: str) -> DataFrame:
    return current_usable(table(spark, d, "points"), DIM)


def _pivot_points(raw: DataFrame, n: int) -> DataFrame:
    """Points from which pivots are chosen: those of a share of the labels, all versions of which are read, so they are current too."""
    share = max(1, n // max(2 * SAMPLE_ROWS, 4 * n // CELL_ROWS))  # a few times as many points as are sampled
    return current_usable(raw.where(F.pmod(F.xxhash64("label"), F.lit(share)) == 0), DIM)


def _groups(spark: SparkSession, d: str, singles: bool = False) -> DataFrame:
    """Density peaks over current usable points."""
    raw = table(spark, d, "points")
    n = raw.count()
    return density_peaks(current_packed(raw, DIM), DIM, pivot_points=_pivot_points(raw, n), n=n, singles=singles)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of at least 6 points; a group is named by its least id."""
    return large_groups(_groups(spark, d)).select("id", "group_id")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their size and most typical members."""
    groups = describe_groups(_groups(spark, d))
    return groups.select("group_id", "size", F.array_join(F.transform("typical", lambda i: i.cast("string")), ",").alias("typical"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """Every point with its group, peak, density and distance to the nearest denser neighbour."""
    rounded = [(F.round(c, 6) + 0.0).alias(c) for c in ("density", "delta")]
    return _groups(spark, d, singles=True).select("id", "group_id", "peak", *rounded)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The 10 points nearest to each probe, as pairs with the smaller id first."""
    probes = table(spark, d, "probes").select("label").distinct()
    queries = current_usable(table(spark, d, "points").join(probes, "label", "left_semi"), DIM)
    near = similar_vectors(current_packed(table(spark, d, "points"), DIM), queries, 10, DIM)
    return near.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 points nearest to every point whose id is divisible by 20, against all points, with distances."""
    queries = current_usable(table(spark, d, "points").where("id % 20 = 0"), DIM)
    near = similar_vectors(current_packed(table(spark, d, "points"), DIM), queries, 10, DIM)
    return near.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _subset(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "points")
    packed, n = current_packed(raw, DIM), raw.count()
    return varied_subset(packed, DIM, members=linked_groups(packed, DIM, pivot_points=_pivot_points(raw, n), n=n), n=n)


def p5_subset(spark: SparkSession, d: str) -> DataFrame:
    """256 points that cover the variety of all current usable points."""
    return _subset(spark, d)


def p5_represented(spark: SparkSession, d: str) -> DataFrame:
    """For each member of the subset, how many points are nearest to it, and how far they are."""
    per = represented(_points(spark, d), _subset(spark, d), DIM)
    return per.groupBy("member").agg(F.count("*").alias("n_points"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text or piece of a text."""
    return pack_documents(table(spark, d, "documents"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return container_fill(pack_documents(table(spark, d, "documents")))


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least number possible, and the share of room unused."""
    fill = container_fill(pack_documents(table(spark, d, "documents")))
    total = fill.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.withColumn("least", F.ceil(F.col("tokens") / CAPACITY)).withColumn("unused_share", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * CAPACITY)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items whose passage, or 12 consecutive words of it, they hold."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every maximal match with its place and length in words."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: in how many documents, and the longest match."""
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents that remain when those with leaks are removed."""
    return without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "lang", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue, filler, an error page or a script notice instead of content."""
    return find_residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same with the section, the kind of residue and its share."""
    return find_residue(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p1_members, p3_found, p3_neighbours, p5_subset, p5_represented, p6_packing, p6_containers, p6_waste, p7_found, p7_matches, p7_items, p7_clean, p8_found, p8_kinds)}

_USABLE = """cur AS (SELECT id::BIGINT AS id, data FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS rn FROM points) WHERE rn = 1 AND len(data) = 64
  AND len(list_filter(data, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(data, lambda x: x <> 0)) > 0)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NEAR = f"""n AS (SELECT id, data, sqrt({_DOT.format(a="data", b="data")}) AS l FROM cur),
r AS (SELECT q.id AS query_id, p.id AS id, 1 - {_DOT.format(a="q.data", b="p.data")} / (q.l * p.l) AS distance FROM n p JOIN n q ON p.id <> q.id WHERE {{queries}}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r)"""

_COS = "list_cosine_distance({}::DOUBLE[], {}::DOUBLE[])"
_PEAKS = f"""{_USABLE}, link AS (SELECT a.id AS a, b.id AS b, {_COS.format("a.data", "b.data")} AS d FROM cur a JOIN cur b ON a.id <> b.id AND {_COS.format("a.data", "b.data")} <= 0.05),
reach AS (SELECT DISTINCT a AS id, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id), g AS (SELECT id, min(root) AS group_id FROM reach GROUP BY 1),
dens AS (SELECT c.id, coalesce(any_value(g.group_id), c.id) AS group_id, coalesce(round(sum(1 - l.d / 0.05), 9), 0) AS density FROM cur c LEFT JOIN g ON g.id = c.id LEFT JOIN link l ON l.a = c.id GROUP BY c.id)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_USABLE}, link AS (SELECT a.id AS a, b.id AS b FROM cur a JOIN cur b ON a.id <> b.id AND list_cosine_distance(a.data::DOUBLE[], b.data::DOUBLE[]) <= 0.05),
reach AS (SELECT DISTINCT a AS id, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
g AS (SELECT id, min(root) AS group_id FROM reach GROUP BY 1) SELECT id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY 1 HAVING count(*) >= 6)""",
    "p1_groups": f"""WITH RECURSIVE {_PEAKS} SELECT group_id, count(*) AS size, array_to_string(list(id ORDER BY density DESC, id)[:5], ',') AS typical FROM dens GROUP BY 1 HAVING count(*) >= 6""",
    "p1_members": f"""WITH RECURSIVE {_PEAKS},
pair AS (SELECT a.id, b.id AS other, {_COS.format("x.data", "y.data")} AS d, b.density > a.density OR (b.density = a.density AND b.id < a.id) AS denser FROM dens a JOIN dens b ON a.group_id = b.group_id AND a.id <> b.id JOIN cur x ON x.id = a.id JOIN cur y ON y.id = b.id),
up AS (SELECT id, coalesce(arg_min(other, d) FILTER (denser AND d <= 0.05), id) AS up, coalesce(min(d) FILTER (denser), max(d)) AS delta FROM pair GROUP BY 1),
chase AS (SELECT id, up FROM up UNION SELECT c.id, u.up FROM chase c JOIN up u ON c.up = u.id)
SELECT s.id, s.group_id, coalesce(c.up, s.id) AS peak, round(s.density, 6) + 0.0 AS density, round(coalesce(u.delta, 0), 6) + 0.0 AS delta FROM dens s LEFT JOIN up u ON u.id = s.id LEFT JOIN (SELECT id, up FROM chase WHERE up IN (SELECT id FROM up WHERE id = up)) c ON c.id = s.id""",
    "p3_found": f"WITH {_USABLE}, {_NEAR.format(queries='q.id IN (SELECT id FROM probes)')} SELECT DISTINCT least(query_id, id) AS id_a, greatest(query_id, id) AS id_b FROM k WHERE rank <= 10",
}
