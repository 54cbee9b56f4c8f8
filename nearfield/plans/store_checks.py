"""Queries over the two copies of the store: differences (p2_) and dangling references (p4_), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.diff import diff_tables
from nearfield.operators.orphans import direct_orphans, edge_references, key_references, orphan_cascade
from nearfield.plans.tables import table
from nearfield.session import materialize

PAIRS = (("store_points", "label", ["id", "data", "created_time"]), ("store_nodes", "id", ["out_edges", "in_edges"]))


def store_diff(spark: SparkSession, d: str, values: bool = False) -> DataFrame:
    points, nodes = (diff_tables(table(spark, d, t), table(spark, d, t + "_copy"), key, fields, t, values) for t, key, fields in PAIRS)
    return points.unionAll(nodes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows only one copy has and fields whose values differ."""
    return store_diff(spark, d)


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same with both values as text."""
    return store_diff(spark, d, values=True)


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Differences counted per table and kind."""
    return store_diff(spark, d).groupBy("table_name", "diff").agg(F.count("*").alias("n"))


def store_orphans(spark: SparkSession, d: str, max_rounds: int | None = None) -> DataFrame:
    nodes, removed = table(spark, d, "store_nodes"), table(spark, d, "removed_indexes")
    held = edge_references(nodes)
    if max_rounds != 0:
        held = materialize(held, "references")
    listed = key_references(removed, "index_id", "removed_indexes", "removed_at")
    gone = removed.select(F.col("index_id").alias("id"))
    direct = direct_orphans(held.unionByName(listed), nodes.select("id", "saved_at"), gone, missing_only=("removed_indexes",))
    return orphan_cascade(held, direct, "store_nodes", max_rounds)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every dangling reference: the step of the cascade that finds those orphaned directly; the rounds of inheritance add none."""
    return store_orphans(spark, d, max_rounds=0).select("ref_table", "ref_id", "ref_field", "target_id", "reason").distinct()


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Records orphaned directly (depth 0) or by inheritance, with their depth."""
    return store_orphans(spark, d).groupBy("ref_table", "ref_id").agg(F.min("depth").alias("depth"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month of saved_at or removed_at, and reason; inherited ones beside the direct ones."""
    month = F.date_format(F.date_trunc("month", "ref_time"), "yyyy-MM")
    return store_orphans(spark, d).groupBy("ref_table", month.alias("month"), "reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_cells, p2_summary, p4_found, p4_cascade, p4_report)}


def _diff_sql() -> str:
    parts = []
    for t, key, fields in PAIRS:
        cols = ", ".join(fields)
        k = f"CAST({key} AS VARCHAR)"
        a, b = (f"(SELECT DISTINCT {key}, {cols} FROM {x})" for x in (t, t + "_copy"))
        parts.append(f"SELECT '{t}' AS table_name, {k} AS row_key, 'only_first' AS diff FROM {a} WHERE {key} NOT IN (SELECT {key} FROM {t}_copy)")
        parts.append(f"SELECT '{t}', {k}, 'only_second' FROM {b} WHERE {key} NOT IN (SELECT {key} FROM {t})")
        parts += [f"SELECT '{t}', CAST(a.{key} AS VARCHAR), '{f}' FROM {a} a JOIN {b} b ON a.{key} = b.{key} WHERE a.{f} IS DISTINCT FROM b.{f}" for f in fields]
    return " UNION ALL ".join(parts)


_REFS = """refs AS (
  SELECT DISTINCT CAST(id AS BIGINT) AS ref_id, 'out_edges' AS ref_field, CAST(t AS BIGINT) AS target_id, saved_at FROM (SELECT id, saved_at, unnest(flatten(out_edges)) AS t FROM store_nodes) WHERE t IS NOT NULL
  UNION SELECT DISTINCT CAST(id AS BIGINT), 'in_edges', CAST(t AS BIGINT), saved_at FROM (SELECT id, saved_at, unnest(flatten(in_edges)) AS t FROM store_nodes) WHERE t IS NOT NULL),
known AS (SELECT CAST(id AS BIGINT) AS id, min(saved_at) AS saved FROM store_nodes GROUP BY 1),
gone AS (SELECT DISTINCT CAST(index_id AS BIGINT) AS id FROM removed_indexes WHERE index_id IS NOT NULL),
judged AS (
  SELECT ref_id, ref_field, target_id, saved_at AS ref_time, CASE WHEN k.id IS NULL THEN 'missing' WHEN g.id IS NOT NULL THEN 'removed' WHEN k.saved > r.saved_at + INTERVAL 7 DAY THEN 'late' END AS reason
  FROM refs r LEFT JOIN known k ON k.id = r.target_id LEFT JOIN gone g ON g.id = r.target_id),
direct AS (
  SELECT 'store_nodes' AS ref_table, ref_id, ref_field, target_id, ref_time, reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT DISTINCT 'removed_indexes', CAST(index_id AS BIGINT), 'index_id', CAST(index_id AS BIGINT), removed_at, 'missing' FROM removed_indexes WHERE index_id IS NOT NULL AND index_id NOT IN (SELECT id FROM store_nodes WHERE id IS NOT NULL))"""

_REACH = """depths(id, depth) USING KEY (id) AS (
  SELECT DISTINCT ref_id, 0 FROM direct WHERE ref_table = 'store_nodes'
  UNION SELECT r.ref_id, min(d.depth) + 1 FROM depths d JOIN refs r ON r.target_id = d.id WHERE r.ref_id NOT IN (SELECT id FROM recurring.depths) GROUP BY r.ref_id)"""

_REPORT = """inherited AS (SELECT r.ref_id, min({'t': r.target_id, 'f': r.ref_field, 's': r.saved_at}) AS m FROM refs r JOIN depths a ON a.id = r.ref_id JOIN depths b ON b.id = r.target_id WHERE a.depth > 0 AND b.depth = a.depth - 1 GROUP BY 1),
lines AS (SELECT ref_table, ref_time, reason FROM direct UNION ALL SELECT 'store_nodes', m.s, 'inherited' FROM inherited)
SELECT ref_table, strftime(ref_time, '%Y-%m') AS month, reason, count(*) AS n FROM lines GROUP BY ALL"""

_CELLS = "SELECT table_name, diff, count(*) AS n FROM ({}) GROUP BY 1, 2"

ORACLES = {
    "p2_found": _diff_sql(),
    "p2_summary": _CELLS.format(_diff_sql()),
    "p4_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, ref_field, target_id, reason FROM direct",
    "p4_cascade": f"WITH RECURSIVE {_REFS}, {_REACH} SELECT 'store_nodes' AS ref_table, id AS ref_id, CAST(depth AS INTEGER) AS depth FROM depths UNION ALL SELECT DISTINCT ref_table, ref_id, 0 FROM direct WHERE ref_table <> 'store_nodes'",
    "p4_report": f"WITH RECURSIVE {_REFS}, {_REACH}, {_REPORT}",
}
