"""Queries of the general data problems (3, 4 and 6), with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.operators import intervals, snapshots
from stratagraph.runtime import cut
from stratagraph.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshots.orphan_references(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "graph_edges"))
    return found.select("head_sha", "edge_type", "src_key", "dst_key", "side")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, manifest = (table(spark, sf_dir, t) for t in ("graph_nodes", "graph_edges", "snapshot_manifest"))
    return snapshots.orphan_report(snapshots.orphan_references(nodes, edges), edges, manifest)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.claim_periods(table(spark, sf_dir, "claims"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, manifest = (table(spark, sf_dir, t) for t in ("graph_nodes", "graph_edges", "snapshot_manifest"))
    # The order is counted and joined: cut, it reads the nodes once for both.
    return snapshots.snapshot_diff(snapshots.record_rows(nodes, edges), cut(snapshots.snapshot_order(manifest, nodes)))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot and kind of record, how many were added, removed and changed."""
    return p6_found(spark, sf_dir).groupBy("head_sha", "rec", "rec_type", "diff_kind").count().withColumnRenamed("count", "n")


_P3 = """
WITH n AS (SELECT DISTINCT project, head_sha, label, node_key FROM graph_nodes),
e AS (SELECT DISTINCT project, head_sha, edge_type, src_label, src_key, dst_label, dst_key FROM graph_edges WHERE dst_key IS NOT NULL AND src_key IS NOT NULL),
f AS (
  SELECT DISTINCT e.project, e.head_sha, edge_type, src_key, dst_key, 'src' AS side FROM e ANTI JOIN n ON e.project = n.project AND e.head_sha = n.head_sha AND e.src_label = n.label AND e.src_key = n.node_key
  UNION ALL
  SELECT DISTINCT e.project, e.head_sha, edge_type, src_key, dst_key, 'dst' AS side FROM e ANTI JOIN n ON e.project = n.project AND e.head_sha = n.head_sha AND e.dst_label = n.label AND e.dst_key = n.node_key)
"""

_P4 = """
WITH x AS (SELECT DISTINCT lower(trim(subject)) AS subject, CAST(floor(CASE WHEN valid_at > 1e11 THEN valid_at / 1000 ELSE valid_at END) AS BIGINT) AS s,
    CASE WHEN valid_to IS NULL THEN 9223372036854775807 ELSE CAST(floor(CASE WHEN valid_to > 1e11 THEN valid_to / 1000 ELSE valid_to END) AS BIGINT) END AS e
  FROM claims WHERE valid_at IS NOT NULL AND subject IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x WHERE e > s),
z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y),
p AS (SELECT subject, island, min(s) AS a, max(e) AS b FROM z GROUP BY subject, island)
SELECT subject, 'period' AS kind, a AS from_s, CASE WHEN b = 9223372036854775807 THEN -1 ELSE b END AS to_s FROM p
UNION ALL
SELECT subject, 'gap' AS kind, b AS from_s, n AS to_s FROM (SELECT *, lead(a) OVER (PARTITION BY subject ORDER BY island) AS n FROM p) WHERE n IS NOT NULL
"""

_P6 = """
WITH m AS (SELECT project, head_sha, min(created_at) AS t FROM snapshot_manifest GROUP BY ALL),
o AS (SELECT m.project, m.head_sha, row_number() OVER (PARTITION BY m.project ORDER BY t, m.head_sha) AS idx
  FROM m SEMI JOIN graph_nodes g ON m.project = g.project AND m.head_sha = g.head_sha),
r AS (
  SELECT project, head_sha, 'node' AS rec, label AS rec_type, node_key AS key_a, '' AS key_b, props, loaded_at FROM graph_nodes
  UNION ALL SELECT project, head_sha, 'edge', edge_type, src_key, dst_key, props, loaded_at FROM graph_edges WHERE dst_key IS NOT NULL),
d AS (SELECT project, head_sha, rec, rec_type, key_a, key_b, arg_max(props, loaded_at) AS props FROM r GROUP BY ALL),
c AS (SELECT d.project, idx, rec, rec_type, key_a, key_b, list_sort([k || '=' || CAST(json_extract(props, '$."' || k || '"') AS VARCHAR) FOR k IN json_keys(props)]) AS v
  FROM d JOIN o ON d.project = o.project AND d.head_sha = o.head_sha),
u AS (SELECT coalesce(a.project, b.project) AS project, coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.rec, b.rec) AS rec, coalesce(a.rec_type, b.rec_type) AS rec_type,
    coalesce(a.key_a, b.key_a) AS key_a, coalesce(a.key_b, b.key_b) AS key_b, CASE WHEN b.idx IS NULL THEN 'added' WHEN a.idx IS NULL THEN 'removed' ELSE 'changed' END AS diff_kind
  FROM c a FULL JOIN c b ON a.project = b.project AND a.idx = b.idx + 1 AND a.rec = b.rec AND a.rec_type = b.rec_type AND a.key_a = b.key_a AND a.key_b = b.key_b
  WHERE a.idx IS NULL OR b.idx IS NULL OR a.v <> b.v),
f AS (SELECT o.head_sha, rec, rec_type, key_a, key_b, diff_kind FROM u JOIN o ON u.project = o.project AND u.idx = o.idx WHERE u.idx > 1)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p6_found": p6_found, "p6_counts": p6_counts}

SQL = {
    "p3_found": _P3 + "SELECT head_sha, edge_type, src_key, dst_key, side FROM f",
    "p3_report": _P3 + """,
m AS (SELECT project, head_sha, strftime(make_timestamp(CAST(min(created_at) * 1000000 AS BIGINT)), '%Y-%m') AS month FROM snapshot_manifest GROUP BY ALL),
k AS (SELECT project, head_sha, edge_type, count(*) AS n FROM (SELECT DISTINCT project, head_sha, edge_type, src_key, dst_key FROM e) GROUP BY ALL),
s AS (SELECT *, unnest(['src', 'dst']) AS side FROM k),
l AS (SELECT project, head_sha, edge_type, side, count(*) AS lost FROM f GROUP BY ALL)
SELECT s.edge_type, s.side, coalesce(month, 'unknown') AS month, CAST(sum(n) AS BIGINT) AS n_edges, CAST(coalesce(sum(lost), 0) AS BIGINT) AS n_orphans
FROM s LEFT JOIN l USING (project, head_sha, edge_type, side) LEFT JOIN m USING (project, head_sha) GROUP BY ALL""",
    "p4_found": _P4,
    "p6_found": _P6 + "SELECT * FROM f",
    "p6_counts": _P6 + "SELECT head_sha, rec, rec_type, diff_kind, count(*) AS n FROM f GROUP BY ALL",
}
