"""Queries of the general problems (1 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import references, snapshots
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.consecutive(table(spark, d, "node_snapshots"), table(spark, d, "snapshots"))


def p1_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.changed_fields(table(spark, d, "node_snapshots"), table(spark, d, "snapshots"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(table(spark, d, "edges"), table(spark, d, "nodes")).select("edge_id", "side", "reason")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(table(spark, d, "edges"), table(spark, d, "nodes"))


QUERIES = {"p1_found": p1_found, "p1_changed_fields": p1_changed_fields, "p5_found": p5_found, "p5_counts": p5_counts}


def clean(c: str) -> str:
    return f"trim(replace({c}, '\\', '/'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


FIELDS = ["type", "name", "language", "file_path", "line_range", "signature", "file_hash", "layer", "complexity", "tags"]

STATES = f"""
s0 AS (
  SELECT repo, {clean('id')} AS id, snapshot_no, loaded_at, coalesce(type, '') AS type, coalesce(name, '') AS name, coalesce(language, '') AS language,
         coalesce({clean('file_path')}, '') AS file_path, coalesce(concat_ws(':', line_range."start"::VARCHAR, line_range."end"::VARCHAR), '') AS line_range,
         trim(regexp_replace(coalesce(signature, ''), '\\s+', ' ', 'g')) AS signature, coalesce(file_hash, '') AS file_hash,
         coalesce(layer, '') AS layer, coalesce(complexity, '') AS complexity, coalesce(array_to_string(list_sort(list_distinct(tags)), ','), '') AS tags
  FROM node_snapshots WHERE id IS NOT NULL),
s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, id ORDER BY loaded_at DESC) = 1),
nos AS (SELECT repo, snapshot_no, lead(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT repo, snapshot_no FROM snapshots)),
old AS (SELECT s1.*, next_no FROM s1 JOIN nos USING (repo, snapshot_no) WHERE next_no IS NOT NULL),
new AS (SELECT s1.* FROM s1 JOIN (SELECT repo, next_no AS snapshot_no FROM nos WHERE next_no IS NOT NULL) USING (repo, snapshot_no)),
both_sides AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.next_no) AS snapshot_no, coalesce(n.id, o.id) AS id, n.id AS n_id, o.id AS o_id,
         {', '.join(f'o.{f} AS o_{f}, n.{f} AS n_{f}' for f in FIELDS)}
  FROM old o FULL JOIN new n ON o.repo = n.repo AND o.next_no = n.snapshot_no AND o.id = n.id)"""

ORPHANS = f"""
n AS (SELECT DISTINCT {clean('id')} AS id, created_at, deleted_at FROM nodes WHERE id IS NOT NULL),
e AS (
  SELECT DISTINCT {clean('id')} AS edge_id, type AS edge_type, created_at AS ts, 'from' AS side, {clean('from_id')} AS k FROM edges WHERE from_id IS NOT NULL
  UNION SELECT DISTINCT {clean('id')}, type, created_at, 'to', {clean('to_id')} FROM edges WHERE to_id IS NOT NULL AND coalesce(unresolved, false) = false),
cases AS (
  SELECT edge_id, edge_type, side, ts,
         CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.k) THEN 'missing'
              WHEN EXISTS (SELECT 1 FROM n WHERE n.id = e.k AND n.created_at > e.ts) THEN 'late' ELSE 'deleted' END AS reason
  FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.k AND n.created_at <= e.ts AND (n.deleted_at IS NULL OR n.deleted_at > e.ts)))"""

ORACLE = {
    "p1_found": f"""WITH {STATES}
SELECT repo, snapshot_no, id, CASE WHEN o_id IS NULL THEN 'added' WHEN n_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM both_sides WHERE o_id IS NULL OR n_id IS NULL OR {' OR '.join(f'o_{f} <> n_{f}' for f in FIELDS)}""",
    "p1_changed_fields": f"WITH {STATES} "
    + " UNION ALL ".join(f"SELECT repo, snapshot_no, id, '{f}' AS field, o_{f} AS old_value, n_{f} AS new_value FROM both_sides WHERE o_{f} <> n_{f}" for f in FIELDS),
    "p5_found": f"WITH {ORPHANS} SELECT DISTINCT edge_id, side, reason FROM cases",
    "p5_counts": f"WITH {ORPHANS} SELECT edge_type, strftime(ts, '%Y-%m') AS month, side, reason, count(*) AS cases FROM cases GROUP BY ALL",
}
