"""Queries of the data problems that belong to the core: orphans, incremental runs, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import incremental as I
from ..operators import references as R
from ..session import materialize, read_table, work_path


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("entities", "components", "modules", "edges", "terms", "deletions")
    return R.find_orphans(*(read_table(spark, d, n) for n in names))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "target_id", "period", "reason")


def p2_per_period(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans_per_period(_orphans(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    runner = I.IncrementalRunner(spark, work_path(spark, "runs"))
    return runner.run_log(read_table(spark, d, "entities"), read_table(spark, d, "ingest_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("run_id", "id")


def p6_per_run(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("run_id", "change").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(read_table(spark, d, "edges")).select("node_id", "root_id", "depth")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(read_table(spark, d, "edges"), with_paths=True)
    return tree.filter(F.col("depth") >= 0).select("node_id", F.concat_ws(" > ", "path").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(materialize(H.hierarchy(read_table(spark, d, "edges"), with_paths=True), "tree"))


def p7_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.all_descendants(read_table(spark, d, "edges"))


_PLANS = (p2_found, p2_per_period, p6_found, p6_per_run, p7_found, p7_paths, p7_descendants, p7_all_descendants)
QUERIES = {f.__name__: f for f in _PLANS}

_REFS = """
known AS (
  SELECT id, min(landed_at) AS first_landed, max(landed_at) AS last_landed
  FROM (SELECT id, landed_at FROM entities UNION ALL SELECT id, landed_at FROM components) GROUP BY id),
gone AS (SELECT entity_id AS id, max(deleted_at) AS last_deleted FROM deletions GROUP BY entity_id),
refs AS (
  SELECT 'edges' AS ref_table, 'src' AS ref_field, src AS target_id, landed_at FROM edges
  UNION ALL SELECT 'edges', 'dst', dst, landed_at FROM edges
  UNION ALL SELECT 'components', 'depends_on', unnest(depends_on), landed_at FROM components
  UNION ALL SELECT 'terms', 'entity_id', entity_id, landed_at FROM terms),
cases AS (
  SELECT ref_table, ref_field, target_id, strftime(landed_at, '%Y-%m') AS period,
    CASE WHEN k.id IS NULL THEN 'missing'
         WHEN g.last_deleted >= k.last_landed THEN 'deleted'
         WHEN k.first_landed > landed_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN known k ON k.id = r.target_id LEFT JOIN gone g ON g.id = r.target_id
  WHERE target_id <> '' AND target_id NOT IN (SELECT id FROM modules WHERE id IS NOT NULL))
"""

_RUNS = r"""
ok AS (
  SELECT run_id, source_root, started_at,
    lag(run_id) OVER (PARTITION BY source_root ORDER BY started_at, run_id) AS prev_id
  FROM ingest_runs WHERE status = 'ok' AND finished_at IS NOT NULL),
paths AS (SELECT *, coalesce(regexp_replace(replace(source_path, '\', '/'), '^(\./|/)+', ''), '') AS path FROM entities),
rooted AS (
  SELECT *, CASE WHEN path = '' THEN 'none' ELSE split_part(path, '/', 1) END AS root FROM paths),
states AS (
  SELECT o.run_id, o.prev_id, e.id, md5(to_json([e.type, e.name, e.body, e.metadata, e.path])) AS content
  FROM ok o JOIN rooted e ON e.root = o.source_root AND e.landed_at <= o.started_at
  QUALIFY row_number() OVER (PARTITION BY o.run_id, e.id ORDER BY e.updated_at DESC) = 1),
cases AS (
  SELECT s.run_id, s.id, CASE WHEN b.id IS NULL THEN 'new' ELSE 'changed' END AS change
  FROM states s LEFT JOIN states b ON b.run_id = s.prev_id AND b.id = s.id
  WHERE b.id IS NULL OR b.content <> s.content)
"""

_LINKS = """
links AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT CASE WHEN lower(relation) = 'contains' THEN dst ELSE src END AS child,
           CASE WHEN lower(relation) = 'contains' THEN src ELSE dst END AS parent
    FROM edges WHERE lower(relation) IN ('contains', 'part_of')) GROUP BY child),
tree AS (
  SELECT DISTINCT parent AS node_id, parent AS root_id, 0::BIGINT AS depth, [parent] AS path
  FROM links WHERE parent NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, t.root_id, t.depth + 1, list_append(t.path, l.child) FROM tree t JOIN links l ON l.parent = t.node_id)
"""

ORACLE_SQL = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_field, target_id, period, reason FROM cases WHERE reason IS NOT NULL",
    "p2_per_period": f"""WITH {_REFS} SELECT ref_table, ref_field, period, reason, count(*) AS n_targets, sum(n)::BIGINT AS n_refs
        FROM (SELECT ref_table, ref_field, target_id, period,
                CASE WHEN bool_or(reason = 'missing') THEN 'missing' WHEN bool_or(reason = 'deleted') THEN 'deleted'
                     WHEN bool_or(reason = 'late') THEN 'late' END AS reason, count(*) AS n
              FROM cases GROUP BY ref_table, ref_field, target_id, period)
        WHERE reason IS NOT NULL GROUP BY ref_table, ref_field, period, reason""",
    "p6_found": f"WITH {_RUNS} SELECT run_id, id FROM cases",
    "p6_per_run": f"WITH {_RUNS} SELECT run_id, change, count(*) AS n FROM cases GROUP BY run_id, change",
    "p7_found": f"""WITH RECURSIVE {_LINKS},
        walk AS (
          SELECT child AS node_id, child AS cur, [child] AS seen, false AS closed
          FROM links WHERE child NOT IN (SELECT node_id FROM tree)
          UNION ALL
          SELECT w.node_id, l.parent, list_append(w.seen, l.parent), list_contains(w.seen, l.parent)
          FROM walk w JOIN links l ON l.child = w.cur WHERE NOT w.closed)
        SELECT node_id, root_id, depth FROM tree
        UNION ALL
        SELECT node_id, list_min(seen[list_position(seen, cur):]) AS root_id, -1 AS depth FROM walk WHERE closed""",
    "p7_paths": f"WITH RECURSIVE {_LINKS} SELECT node_id, array_to_string(path, ' > ') AS path FROM tree",
    "p7_descendants": f"""WITH RECURSIVE {_LINKS}
        SELECT path[i] AS ancestor_id, node_id, depth + 1 - i AS distance
        FROM (SELECT node_id, depth, path, unnest(range(1, len(path))) AS i FROM tree)""",
    "p7_all_descendants": f"""WITH RECURSIVE {_LINKS},
        up AS (
          SELECT parent AS ancestor_id, child AS node_id, 1::BIGINT AS distance, [child, parent] AS seen FROM links WHERE child <> parent
          UNION ALL
          SELECT l.parent, u.node_id, u.distance + 1, list_append(u.seen, l.parent)
          FROM up u JOIN links l ON l.child = u.ancestor_id WHERE NOT list_contains(u.seen, l.parent))
        SELECT ancestor_id, node_id, distance FROM up""",
}
