"""Topology, time travel, tombstones and resolution over the graph tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import graph, resolve
from stratagraph.operators.snapshots import snapshot_order
from stratagraph.runtime import cut
from stratagraph.sources.tables import table

#: The ordinal asked for in time-travel queries, and the epoch seconds before which tombstones are vacuumed by age.
ORDINAL, BEFORE = 2, 1_719_000_000.0


def _order(spark: SparkSession, d: str) -> DataFrame:
    return cut(snapshot_order(table(spark, d, "snapshot_manifest"), table(spark, d, "graph_nodes")))


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lifecycle tables of nodes and edges, and the order of snapshots."""
    order = _order(spark, d)
    return graph.lifecycle(graph.parse_nodes(table(spark, d, "graph_nodes")), order, graph.NODE), graph.lifecycle(graph.parse_edges(table(spark, d, "graph_edges")), order, graph.EDGE), order


_STAMPS = ["first_seen_ord", "first_seen_sha", "last_seen_ord", "last_seen_sha", "invalid_ord", "invalid_sha"]


def q_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)[0].select(*graph.NODE, "name", "kind", "file", "start", "end", "params", "unresolved", *_STAMPS)


def q_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)[1].select(*graph.EDGE, "args", "resolved", "confidence", *_STAMPS)


def q_missing_endpoints(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.missing_endpoints(n, e)


def q_definitions(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.definitions(n, e)


def q_callers(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.callers(n, e)


def q_callers_live(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.callers(n, e, live_edges=True)


def q_callees(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.callees(n, e)


def q_injects(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.injects(n, e)


def q_injectors(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.injectors(n, e)


def q_importers(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.importers(n, e)


def q_dependencies(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.dependencies(n, e)


def _callers_depth(depth: int):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        n, e = graph.slim(*tables(spark, d)[:2])
        return graph.callers_multi(n, e, graph.most_called(n, e), depth)

    return run


def q_callees_depth2(spark: SparkSession, d: str) -> DataFrame:
    n, e = graph.slim(*tables(spark, d)[:2])
    return graph.callees_multi(n, e, graph.most_called(n, e), 2)


def q_neighbors_2(spark: SparkSession, d: str) -> DataFrame:
    e = cut(tables(spark, d)[1])
    return graph.neighbors(e, graph.busiest_file(e), 2)


def q_at_sha(spark: SparkSession, d: str) -> DataFrame:
    return graph.alive_at(tables(spark, d)[0], ORDINAL).select(*graph.NODE, "first_seen_sha", "last_seen_sha", "invalid_sha")


def q_callers_at_sha(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return graph.callers_at(n, e, ORDINAL)


def q_drift(spark: SparkSession, d: str) -> DataFrame:
    n, _, order = tables(spark, d)
    return graph.drift(n, graph.heads(order))


def q_node_counts(spark: SparkSession, d: str) -> DataFrame:
    """Live and all nodes per project and label, with a total per project and over all."""
    n = tables(spark, d)[0]
    return n.rollup("project", "label").agg(F.count("*").alias("n_all"), F.count_if(F.col("invalid_sha").isNull()).alias("n_live"))


def q_delete_file(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones of the files marked as generated: what is dead afterwards."""
    n, e, _ = tables(spark, d)
    files = n.where("label = 'File' and generated").select("project", F.col("key").alias("file"))
    n2, e2 = graph.delete_files(n, e, files, "deleted", 99, 2e9)
    dead_n = n2.where("invalid_sha = 'deleted'").select("project", F.lit("node").alias("rec"), F.col("label").alias("rec_type"), F.col("key").alias("key_a"), F.lit("").alias("key_b"), "invalid_ord")
    return dead_n.unionByName(e2.where("invalid_sha = 'deleted'").select("project", F.lit("edge").alias("rec"), F.col("type").alias("rec_type"), F.col("src_key").alias("key_a"), F.concat_ws("|", "dst_label", "dst_key").alias("key_b"), "invalid_ord"))


def _vacuum(**mode):  # noqa: ANN003, ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        n, e, _ = tables(spark, d)
        return graph.vacuum(n, e, **mode)[2]

    return run


def q_resolve(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    refs = resolve.placeholder_edges(n, e)
    return resolve.resolve(refs, resolve.definition_index(n, e), resolve.relative_imports(e)).drop("assembly")


def q_resolve_stats(spark: SparkSession, d: str) -> DataFrame:
    return q_resolve(spark, d).groupBy("type", "tier").agg(F.count("*").alias("n"))


def q_resolve_receiver(spark: SparkSession, d: str) -> DataFrame:
    """Resolution where calls say what type they are made on.

    The tables have no receivers, so each called name gets one: the least other name that the first file defining it defines.
    """
    n, e, _ = tables(spark, d)
    defs = cut(resolve.definition_index(n, e))
    home = defs.groupBy("project", "name").agg(F.min("def_file").alias("def_file"))
    beside = home.join(defs.select("project", "def_file", F.col("name").alias("other")), ["project", "def_file"]).where("other <> name").groupBy("project", "name").agg(F.min("other").alias("r"))
    refs = resolve.placeholder_edges(n, e).join(beside, ["project", "name"], "left").withColumn("receiver_type", F.when(F.col("type") == "CALLS", F.col("r"))).drop("r")
    return resolve.resolve(refs, defs, resolve.relative_imports(e)).drop("assembly")


def _rewritten(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e, _ = tables(spark, d)
    n, e = cut(n), cut(e)
    return n, resolve.rewrite(e, resolve.resolve(resolve.placeholder_edges(n, e), resolve.definition_index(n, e), resolve.relative_imports(e)))


def q_resolve_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """All edges after resolved ones have been written back."""
    return _rewritten(spark, d)[1].select(*graph.EDGE, "args", "resolved", "confidence", "first_seen_ord")


def q_orphans_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders that nothing points to once the edges have been written back."""
    return resolve.orphan_placeholders(*_rewritten(spark, d))


def q_alias_edges(spark: SparkSession, d: str) -> DataFrame:
    """Further names of what files import: here the imports' own text is the path they mean."""
    n, e, _ = tables(spark, d)
    return resolve.alias_edges(resolve.relative_imports(e).withColumn("module", F.col("target")), resolve.import_aliases(n))


def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = tables(spark, d)
    return resolve.orphan_placeholders(n, e)


def q_import_alias(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_aliases(tables(spark, d)[0])


def q_file_project(spark: SparkSession, d: str) -> DataFrame:
    """The innermost directory with at least three live files below it, at any depth, that contains each live file."""
    f = tables(spark, d)[0].where("label = 'File' and invalid_sha is null").select("project", F.col("key").alias("file"))
    above = f.where("instr(file, '/') > 0").select("project", F.explode(F.expr("transform(sequence(1, size(split(file, '/')) - 1), i -> substring_index(file, '/', i))")).alias("root"))
    roots = above.groupBy("project", "root").agg(F.count("*").alias("n")).where("n >= 3")
    return resolve.containing(f, roots)


QUERIES = {
    "q_definitions": q_definitions, "q_callers": q_callers, "q_callers_live": q_callers_live, "q_callees": q_callees, "q_injects": q_injects, "q_injectors": q_injectors,
    "q_importers": q_importers, "q_dependencies": q_dependencies, "q_callers_depth2": _callers_depth(2), "q_callers_depth3": _callers_depth(3), "q_callees_depth2": q_callees_depth2,
    "q_neighbors_2": q_neighbors_2, "q_upsert_nodes": q_upsert_nodes, "q_upsert_edges": q_upsert_edges, "q_missing_endpoints": q_missing_endpoints, "q_delete_file": q_delete_file,
    "q_vacuum_before": _vacuum(before_ord=3), "q_vacuum_age": _vacuum(before_at=BEFORE), "q_vacuum_all": _vacuum(drop_all=True), "q_at_sha": q_at_sha, "q_callers_at_sha": q_callers_at_sha,
    "q_drift": q_drift, "q_node_counts": q_node_counts, "q_resolve": q_resolve, "q_resolve_stats": q_resolve_stats, "q_resolve_receiver": q_resolve_receiver, "q_resolve_rewrite": q_resolve_rewrite, "q_orphans_rewritten": q_orphans_rewritten, "q_alias_edges": q_alias_edges, "q_orphans": q_orphans, "q_import_alias": q_import_alias, "q_file_project": q_file_project,
}

_G = """
WITH RECURSIVE m AS (SELECT project, head_sha, min(created_at) AS t FROM snapshot_manifest WHERE created_at IS NOT NULL GROUP BY ALL),
o AS (SELECT m.project, m.head_sha, t, row_number() OVER (PARTITION BY m.project ORDER BY t, m.head_sha) AS idx FROM m SEMI JOIN graph_nodes g ON m.project = g.project AND m.head_sha = g.head_sha),
hd AS (SELECT project, head_sha, idx FROM o QUALIFY idx = max(idx) OVER (PARTITION BY project)),
gn AS (SELECT g.project, label, node_key AS key, o.head_sha, idx, json_extract_string(props, '$.name') AS name, json_extract_string(props, '$.kind') AS kind, json_extract_string(props, '$.file') AS file,
    CAST(json_extract(props, '$.start') AS INT) AS start, CAST(json_extract(props, '$.end') AS INT) AS "end", CAST(json_extract(props, '$.params') AS INT) AS params,
    CAST(json_extract(props, '$.unresolved') AS BOOLEAN) AS unresolved, CAST(json_extract(props, '$.generated') AS BOOLEAN) AS generated
  FROM graph_nodes g JOIN o ON g.project = o.project AND g.head_sha = o.head_sha WHERE label IS NOT NULL AND node_key IS NOT NULL),
ge AS (SELECT g.project, edge_type AS type, src_label, src_key, dst_label, dst_key, o.head_sha, idx, CAST(json_extract(props, '$.args') AS INT) AS args,
    CAST(json_extract(props, '$.resolved') AS BOOLEAN) AS resolved, CAST(json_extract(props, '$.unresolved') AS BOOLEAN) AS unresolved, json_extract_string(props, '$.confidence') AS confidence
  FROM graph_edges g JOIN o ON g.project = o.project AND g.head_sha = o.head_sha WHERE dst_key IS NOT NULL AND src_key IS NOT NULL),
n0 AS (SELECT project, label, key, min(idx) AS first_seen_ord, arg_min(head_sha, idx) AS first_seen_sha, max(idx) AS last_seen_ord, arg_max(head_sha, idx) AS last_seen_sha,
    arg_max(name, idx) AS name, arg_max(kind, idx) AS kind, arg_max(file, idx) AS file, arg_max(start, idx) AS start, arg_max("end", idx) AS "end", arg_max(params, idx) AS params,
    arg_max(unresolved, idx) AS unresolved, arg_max(generated, idx) AS generated FROM gn GROUP BY ALL),
n AS (SELECT n0.*, a.idx AS invalid_ord, a.head_sha AS invalid_sha, a.t AS invalid_at FROM n0 LEFT JOIN o a ON n0.project = a.project AND a.idx = n0.last_seen_ord + 1),
e0 AS (SELECT project, type, src_label, src_key, dst_label, dst_key, min(idx) AS first_seen_ord, arg_min(head_sha, idx) AS first_seen_sha, max(idx) AS last_seen_ord, arg_max(head_sha, idx) AS last_seen_sha,
    arg_max(args, idx) AS args, arg_max(resolved, idx) AS resolved, arg_max(unresolved, idx) AS unresolved, arg_max(confidence, idx) AS confidence FROM ge GROUP BY ALL),
e AS (SELECT e0.*, a.idx AS invalid_ord, a.head_sha AS invalid_sha, a.t AS invalid_at FROM e0 LEFT JOIN o a ON e0.project = a.project AND a.idx = e0.last_seen_ord + 1),
sy AS (SELECT * FROM n WHERE label = 'Symbol' AND unresolved IS NULL AND invalid_sha IS NULL),
df AS (SELECT project, src_key AS file, dst_key AS key, src_label, invalid_sha FROM e WHERE type = 'DEFINES' AND dst_label = 'Symbol'),
xf AS (SELECT project, key AS file FROM n WHERE label = 'File' AND invalid_sha IS NOT NULL),
dl AS (SELECT project, file, key FROM df ANTI JOIN xf USING (project, file) WHERE src_label = 'File'),
ca AS (SELECT DISTINCT e.project, sy.name, e.src_key AS caller, sy.file AS target_file, sy.start AS target_start, sy."end" AS target_end, sy.kind AS target_kind
  FROM e JOIN sy ON e.project = sy.project AND e.dst_key = sy.key WHERE e.type IN ('CALLS', 'REFERENCES') AND e.src_label = 'File' AND e.dst_label = 'Symbol' AND (e.project, e.src_key) NOT IN (SELECT (project, file) FROM xf)),
dn AS (SELECT DISTINCT dl.project, dl.file, sy.name FROM dl JOIN sy USING (project, key) WHERE name IS NOT NULL),
mc AS (SELECT project, name FROM (SELECT project, name, count(DISTINCT caller) AS k FROM ca GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY project ORDER BY k DESC, name DESC NULLS LAST) = 1),
ow AS (SELECT DISTINCT dl.project, n.name AS symbol, dl.file AS src FROM dl JOIN n ON n.project = dl.project AND n.label = 'Symbol' AND n.key = dl.key WHERE n.invalid_sha IS NULL),
ct AS (SELECT DISTINCT e.project, e.type, e.src_key AS src, t.name, t.key, t.file, t.start, t."end", t.kind, t.unresolved IS NULL AS resolved, t.label
  FROM e JOIN n t ON t.project = e.project AND t.label = e.dst_label AND t.key = e.dst_key
  WHERE e.type IN ('CALLS', 'INJECTS') AND e.src_label = 'File' AND e.dst_label IN ('Symbol', 'Type') AND t.invalid_sha IS NULL AND NOT EXISTS (SELECT 1 FROM xf WHERE xf.project = e.project AND xf.file = e.src_key)),
ce AS (SELECT DISTINCT ow.project, symbol, ct.name, key, file, start, "end", kind, resolved, label FROM ow JOIN ct USING (project, src) WHERE ct.type = 'CALLS')
"""

_ST = "first_seen_ord, first_seen_sha, last_seen_ord, last_seen_sha, invalid_ord, invalid_sha"

_RINGS = """,
r1 AS (SELECT ca.project, mc.name AS root, ca.caller, 1 AS hop, ca.name, target_file, target_start, target_end, target_kind FROM ca JOIN mc USING (project, name)
  QUALIFY row_number() OVER (PARTITION BY ca.project, mc.name, caller ORDER BY target_file NULLS FIRST, target_start NULLS FIRST, target_end NULLS FIRST, ca.name) = 1),
s2 AS (SELECT DISTINCT r1.project, root, dn.name FROM r1 JOIN dn ON r1.project = dn.project AND r1.caller = dn.file WHERE dn.name <> root),
r2 AS (SELECT ca.project, s2.root, ca.caller, 2 AS hop, ca.name, target_file, target_start, target_end, target_kind FROM ca JOIN s2 USING (project, name)
  WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.project = ca.project AND r1.root = s2.root AND r1.caller = ca.caller)
  QUALIFY row_number() OVER (PARTITION BY ca.project, s2.root, ca.caller ORDER BY target_file NULLS FIRST, target_start NULLS FIRST, target_end NULLS FIRST, ca.name) = 1),
s3 AS (SELECT DISTINCT r2.project, root, dn.name FROM r2 JOIN dn ON r2.project = dn.project AND r2.caller = dn.file
  WHERE dn.name <> root AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.project = r2.project AND s2.root = r2.root AND s2.name = dn.name)),
r3 AS (SELECT ca.project, s3.root, ca.caller, 3 AS hop, ca.name, target_file, target_start, target_end, target_kind FROM ca JOIN s3 USING (project, name)
  WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.project = ca.project AND r1.root = s3.root AND r1.caller = ca.caller)
    AND NOT EXISTS (SELECT 1 FROM r2 WHERE r2.project = ca.project AND r2.root = s3.root AND r2.caller = ca.caller)
  QUALIFY row_number() OVER (PARTITION BY ca.project, s3.root, ca.caller ORDER BY target_file NULLS FIRST, target_start NULLS FIRST, target_end NULLS FIRST, ca.name) = 1)
"""

_RESOLVE = """,
rf AS (SELECT DISTINCT e.project, e.type, e.src_key AS file, e.dst_key AS placeholder, p.name, CASE WHEN e.type = 'CALLS' THEN coalesce(e.args, -1) ELSE -1 END AS arity
  FROM e LEFT JOIN n p ON p.project = e.project AND p.label = 'Symbol' AND p.key = e.dst_key
  WHERE e.type IN ('CALLS', 'INJECTS', 'REFERENCES') AND e.src_label = 'File' AND e.dst_label = 'Symbol' AND e.invalid_sha IS NULL AND starts_with(e.dst_key, 'name::')),
di AS (SELECT df.project, df.file AS def_file, sy.key, sy.name, sy.params FROM df JOIN sy USING (project, key) WHERE df.invalid_sha IS NULL AND sy.name IS NOT NULL),
im AS (SELECT project, src_key AS file, dst_key AS target FROM e WHERE type = 'IMPORTS' AND dst_label = 'File' AND invalid_sha IS NULL),
cs AS (SELECT rf.*, di.key, di.def_file, di.params, coalesce(arity >= 0 AND di.params = arity, false) AS fit, di.def_file = rf.file AS same, EXISTS (SELECT 1 FROM im WHERE im.project = rf.project AND im.file = rf.file AND im.target = di.def_file) AS imp
  FROM rf LEFT JOIN di ON rf.project = di.project AND rf.name = di.name),
ag AS (SELECT project, type, file, placeholder, name, arity,
    count(*) FILTER (same) AS same_n, min(key) FILTER (same) AS same_key, min(key) FILTER (same AND fit) AS same_fit,
    count(key) FILTER (imp) AS imp_n, min(key) FILTER (imp) AS imp_key, count(key) FILTER (imp AND fit) AS imp_fn, min(key) FILTER (imp AND fit) AS imp_fit,
    count(key) AS all_n, min(key) AS all_key, count(key) FILTER (fit) AS all_fn, min(key) FILTER (fit) AS all_fit FROM cs GROUP BY ALL),
rt AS (SELECT *, CASE WHEN name IS NULL OR name = '' THEN 'external' WHEN same_n > 0 THEN 'same_file' WHEN imp_n > 0 THEN CASE WHEN imp_n = 1 OR imp_fn = 1 THEN 'imported' ELSE 'ambiguous' END
    WHEN all_n > 0 THEN CASE WHEN all_n = 1 OR all_fn = 1 THEN 'unique' ELSE 'ambiguous' END ELSE 'external' END AS tier FROM ag),
rs AS (SELECT project, type, file, placeholder, name, arity, tier, CASE tier WHEN 'same_file' THEN coalesce(same_fit, same_key) WHEN 'imported' THEN CASE WHEN imp_n = 1 THEN imp_key ELSE imp_fit END
    WHEN 'unique' THEN CASE WHEN all_n = 1 THEN all_key ELSE all_fit END END AS target, CASE WHEN tier IN ('same_file', 'imported') THEN 'high' WHEN tier = 'unique' THEN 'medium' END AS confidence FROM rt)
"""

# As _RESOLVE, with a receiver for each called name and the tier that goes by it.
_RECEIVER = """,
di AS (SELECT df.project, df.file AS def_file, sy.key, sy.name, sy.params FROM df JOIN sy USING (project, key) WHERE df.invalid_sha IS NULL AND sy.name IS NOT NULL),
hm AS (SELECT project, name, min(def_file) AS def_file FROM di GROUP BY ALL),
rc AS (SELECT hm.project, hm.name, min(b.name) AS receiver FROM hm JOIN di b ON b.project = hm.project AND b.def_file = hm.def_file AND b.name <> hm.name GROUP BY ALL),
r0 AS (SELECT DISTINCT e.project, e.type, e.src_key AS file, e.dst_key AS placeholder, p.name, CASE WHEN e.type = 'CALLS' THEN coalesce(e.args, -1) ELSE -1 END AS arity
  FROM e LEFT JOIN n p ON p.project = e.project AND p.label = 'Symbol' AND p.key = e.dst_key
  WHERE e.type IN ('CALLS', 'INJECTS', 'REFERENCES') AND e.src_label = 'File' AND e.dst_label = 'Symbol' AND e.invalid_sha IS NULL AND starts_with(e.dst_key, 'name::')),
rf AS (SELECT r0.*, CASE WHEN type = 'CALLS' THEN receiver END AS receiver FROM r0 LEFT JOIN rc USING (project, name)),
im AS (SELECT project, src_key AS file, dst_key AS target FROM e WHERE type = 'IMPORTS' AND dst_label = 'File' AND invalid_sha IS NULL),
cs AS (SELECT rf.*, di.key, di.def_file, di.params, coalesce(arity >= 0 AND di.params = arity, false) AS fit, di.def_file = rf.file AS same,
    EXISTS (SELECT 1 FROM im WHERE im.project = rf.project AND im.file = rf.file AND im.target = di.def_file) AS imp, EXISTS (SELECT 1 FROM di o WHERE o.project = rf.project AND o.name = rf.receiver AND o.def_file = di.def_file) AS own
  FROM rf LEFT JOIN di ON rf.project = di.project AND rf.name = di.name),
ag AS (SELECT project, type, file, placeholder, name, arity,
    count(*) FILTER (same) AS same_n, min(key) FILTER (same) AS same_key, min(key) FILTER (same AND fit) AS same_fit,
    count(key) FILTER (imp) AS imp_n, min(key) FILTER (imp) AS imp_key, count(key) FILTER (imp AND fit) AS imp_fn, min(key) FILTER (imp AND fit) AS imp_fit,
    count(key) FILTER (own) AS own_n, min(key) FILTER (own) AS own_key, count(key) FILTER (own AND fit) AS own_fn, min(key) FILTER (own AND fit) AS own_fit,
    count(key) AS all_n, min(key) AS all_key, count(key) FILTER (fit) AS all_fn, min(key) FILTER (fit) AS all_fit FROM cs GROUP BY ALL),
rt AS (SELECT *, CASE WHEN name IS NULL OR name = '' THEN 'external' WHEN same_n > 0 THEN 'same_file' WHEN imp_n > 0 THEN CASE WHEN imp_n = 1 OR imp_fn = 1 THEN 'imported' ELSE 'ambiguous' END
    WHEN own_n = 1 OR own_fn = 1 THEN 'receiver' WHEN all_n > 0 THEN CASE WHEN all_n = 1 OR all_fn = 1 THEN 'unique' ELSE 'ambiguous' END ELSE 'external' END AS tier FROM ag)
SELECT project, type, file, placeholder, name, arity, tier, CASE tier WHEN 'same_file' THEN coalesce(same_fit, same_key) WHEN 'imported' THEN CASE WHEN imp_n = 1 THEN imp_key ELSE imp_fit END WHEN 'receiver' THEN CASE WHEN own_n = 1 THEN own_key ELSE own_fit END
    WHEN 'unique' THEN CASE WHEN all_n = 1 THEN all_key ELSE all_fit END END AS target, CASE WHEN tier IN ('same_file', 'imported', 'receiver') THEN 'high' WHEN tier = 'unique' THEN 'medium' END AS confidence FROM rt
"""

_REWRITE = _RESOLVE + """,
dn2 AS (SELECT project, type, file AS src_key, placeholder AS dst_key, target, confidence FROM rs WHERE target IS NOT NULL),
kp AS (SELECT e.* FROM e WHERE NOT (src_label = 'File' AND dst_label = 'Symbol' AND EXISTS (SELECT 1 FROM dn2 WHERE dn2.project = e.project AND dn2.type = e.type AND dn2.src_key = e.src_key AND dn2.dst_key = e.dst_key))),
fr AS (SELECT project, type, src_key, target, min(confidence) AS c FROM dn2 GROUP BY ALL),
rw AS (SELECT coalesce(kp.project, fr.project) AS project, coalesce(kp.type, fr.type) AS type, coalesce(kp.src_label, 'File') AS src_label, coalesce(kp.src_key, fr.src_key) AS src_key, coalesce(kp.dst_label, 'Symbol') AS dst_label, coalesce(kp.dst_key, fr.target) AS dst_key,
    args, CASE WHEN fr.c IS NOT NULL THEN true ELSE resolved END AS resolved, coalesce(fr.c, confidence) AS confidence, first_seen_ord, kp.invalid_sha
  FROM kp FULL JOIN fr ON kp.project = fr.project AND kp.type = fr.type AND kp.src_label = 'File' AND kp.src_key = fr.src_key AND kp.dst_label = 'Symbol' AND kp.dst_key = fr.target)
"""

_ALIAS = r""",
f AS (SELECT project, key AS file, regexp_extract(key, '[^/]*$') AS base FROM n WHERE label = 'File' AND invalid_sha IS NULL),
g AS (SELECT *, CASE WHEN regexp_matches(base, '.\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem, substr(file, 1, greatest(length(file) - length(base) - 1, 0)) AS dir FROM f),
pk AS (SELECT project, dir FROM g WHERE base = '__init__.py' AND dir <> ''),
cl AS (SELECT g.project, g.file, g.dir, stem AS dotted FROM g UNION ALL
  SELECT cl.project, cl.file, CASE WHEN contains(cl.dir, '/') THEN regexp_replace(cl.dir, '/[^/]*$', '') ELSE '' END, regexp_extract(cl.dir, '[^/]*$') || '.' || dotted FROM cl JOIN pk ON pk.project = cl.project AND pk.dir = cl.dir),
al AS (SELECT project, file, file AS alias FROM g UNION SELECT project, file, stem FROM g UNION SELECT project, file, arg_max(dotted, length(dotted)) FROM cl GROUP BY ALL)
"""

_VACUUM = """,
d AS (SELECT project, CASE label WHEN 'File' THEN 'files' ELSE 'symbols' END AS what FROM n WHERE label IN ('File', 'Symbol') AND invalid_sha IS NOT NULL AND {0} UNION ALL SELECT project, 'edges' FROM e WHERE invalid_sha IS NOT NULL AND {0})
SELECT project, count(*) FILTER (what = 'files') AS files, count(*) FILTER (what = 'symbols') AS symbols, count(*) FILTER (what = 'edges') AS edges FROM d GROUP BY project
"""

SQL = {
    "q_upsert_nodes": _G + f'SELECT project, label, key, name, kind, file, start, "end", params, unresolved, {_ST} FROM n',
    "q_upsert_edges": _G + f"SELECT project, type, src_label, src_key, dst_label, dst_key, args, resolved, confidence, {_ST} FROM e",
    "q_missing_endpoints": _G + "SELECT x.* FROM (SELECT project, src_label AS label, src_key AS key FROM e UNION SELECT project, dst_label, dst_key FROM e) x ANTI JOIN n USING (project, label, key)",
    "q_definitions": _G + "SELECT sy.project, name, dl.file, start, \"end\", kind FROM sy JOIN dl USING (project, key)",
    "q_callers": _G + "SELECT * FROM ca",
    "q_callers_live": _G + """SELECT DISTINCT e.project, sy.name, e.src_key AS caller, sy.file AS target_file, sy.start AS target_start, sy."end" AS target_end, sy.kind AS target_kind
        FROM e JOIN sy ON e.project = sy.project AND e.dst_key = sy.key WHERE e.type IN ('CALLS', 'REFERENCES') AND e.src_label = 'File' AND e.dst_label = 'Symbol' AND e.invalid_sha IS NULL
        AND NOT EXISTS (SELECT 1 FROM xf WHERE xf.project = e.project AND xf.file = e.src_key)""",
    "q_callees": _G + "SELECT * FROM ce",
    "q_injects": _G + "SELECT DISTINCT ow.project, symbol, ct.name, key, file, kind, resolved FROM ow JOIN ct USING (project, src) WHERE ct.type = 'INJECTS'",
    "q_injectors": _G + "SELECT DISTINCT project, name AS token, src AS file FROM ct WHERE type = 'INJECTS' AND label = 'Symbol' AND name IS NOT NULL",
    "q_importers": _G + "SELECT DISTINCT project, src_key AS file, dst_key AS module FROM e WHERE type = 'IMPORTS' AND dst_label = 'Module' AND invalid_sha IS NULL AND (project, src_key) NOT IN (SELECT (project, file) FROM xf)",
    "q_dependencies": _G + """SELECT DISTINCT project, src_key AS file, dst_key AS module FROM e WHERE type = 'IMPORTS' AND dst_label = 'Module' AND (project, src_key) NOT IN (SELECT (project, file) FROM xf)
        AND NOT EXISTS (SELECT 1 FROM n WHERE n.project = e.project AND n.label = 'Module' AND n.key = e.dst_key AND n.invalid_sha IS NOT NULL)""",
    "q_callers_depth2": _G + _RINGS + "SELECT * FROM r1 UNION ALL SELECT * FROM r2",
    "q_callers_depth3": _G + _RINGS + "SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3",
    "q_callees_depth2": _G + """,
c1 AS (SELECT ce.project, mc.name AS root, 1 AS hop, ce.name, ce.file, min(ce.label) AS label, bool_or(resolved) AS resolved FROM ce JOIN mc ON ce.project = mc.project AND ce.symbol = mc.name GROUP BY ALL),
f2 AS (SELECT DISTINCT project, root, file AS src FROM c1 WHERE resolved AND file IS NOT NULL),
c2 AS (SELECT project, f2.root, 2 AS hop, ct.name, ct.file, min(ct.label) AS label, bool_or(resolved) AS resolved FROM f2 JOIN ct USING (project, src) WHERE ct.type = 'CALLS' GROUP BY ALL)
SELECT * FROM c1 UNION ALL SELECT * FROM c2 WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE c1.project = c2.project AND c1.root = c2.root AND c1.name IS NOT DISTINCT FROM c2.name AND c1.file IS NOT DISTINCT FROM c2.file)""",
    "q_neighbors_2": _G + """,
b AS (SELECT project, 'File' AS label, key FROM (SELECT project, src_key AS key, count(*) AS k FROM e WHERE src_label = 'File' GROUP BY project, src_key) QUALIFY row_number() OVER (PARTITION BY project ORDER BY k DESC, key DESC) = 1),
u AS (SELECT project, src_label AS a_l, src_key AS a_k, dst_label AS b_l, dst_key AS b_k FROM e UNION ALL SELECT project, dst_label, dst_key, src_label, src_key FROM e),
w AS (SELECT project, label, key, 0 AS depth FROM b UNION SELECT u.project, b_l, b_k, depth + 1 FROM w JOIN u ON w.project = u.project AND w.label = u.a_l AND w.key = u.a_k WHERE depth < 2)
SELECT DISTINCT project, label, key FROM w ANTI JOIN b USING (project, label, key)""",
    "q_at_sha": _G + "SELECT project, label, key, first_seen_sha, last_seen_sha, invalid_sha FROM n WHERE first_seen_ord <= 2 AND (invalid_ord IS NULL OR invalid_ord > 2)",
    "q_callers_at_sha": _G + """SELECT DISTINCT e.project, s.name, e.src_key AS caller, s.file AS target_file, s.start AS target_start, s."end" AS target_end, s.kind AS target_kind
        FROM e JOIN n s ON e.project = s.project AND s.label = 'Symbol' AND e.dst_key = s.key AND s.unresolved IS NULL JOIN n f ON f.project = e.project AND f.label = 'File' AND f.key = e.src_key
        WHERE e.type IN ('CALLS', 'REFERENCES') AND e.src_label = 'File' AND e.dst_label = 'Symbol' AND e.first_seen_ord <= 2 AND (e.invalid_ord IS NULL OR e.invalid_ord > 2)
          AND s.first_seen_ord <= 2 AND (s.invalid_ord IS NULL OR s.invalid_ord > 2) AND f.first_seen_ord <= 2 AND (f.invalid_ord IS NULL OR f.invalid_ord > 2)""",
    "q_drift": _G + """SELECT n.project, key, name, file, last_seen_sha, invalid_sha, CASE WHEN invalid_sha IS NOT NULL THEN 'tombstoned' ELSE 'drifted' END AS status FROM n JOIN hd USING (project)
        WHERE label = 'Symbol' AND unresolved IS NULL AND (invalid_sha IS NOT NULL OR last_seen_sha <> hd.head_sha)""",
    "q_node_counts": _G + "SELECT project, label, count(*) AS n_all, count(*) FILTER (invalid_sha IS NULL) AS n_live FROM n GROUP BY ROLLUP (project, label)",
    "q_delete_file": _G + """,
fs AS (SELECT project, key AS file FROM n WHERE label = 'File' AND generated),
gone AS (SELECT project, 'File' AS label, file AS key FROM fs UNION SELECT df.project, 'Symbol', df.key FROM df JOIN fs USING (project, file) JOIN n ON n.project = df.project AND n.label = 'Symbol' AND n.key = df.key AND n.unresolved IS NULL WHERE df.src_label = 'File')
SELECT project, 'node' AS rec, label AS rec_type, key AS key_a, '' AS key_b, CAST(99 AS BIGINT) AS invalid_ord FROM n SEMI JOIN gone USING (project, label, key)
UNION ALL SELECT project, 'edge', type, src_key, concat_ws('|', dst_label, dst_key), 99 FROM e WHERE EXISTS (SELECT 1 FROM gone g WHERE g.project = e.project AND ((g.label = e.src_label AND g.key = e.src_key) OR (g.label = e.dst_label AND g.key = e.dst_key)))""",
    "q_vacuum_before": _G + _VACUUM.format("invalid_ord <= 3"),
    "q_vacuum_age": _G + _VACUUM.format(f"invalid_at <= {BEFORE}"),
    "q_vacuum_all": _G + _VACUUM.format("true"),
    "q_resolve": _G + _RESOLVE + "SELECT * FROM rs",
    "q_resolve_stats": _G + _RESOLVE + "SELECT type, tier, count(*) AS n FROM rs GROUP BY ALL",
    "q_resolve_receiver": _G + _RECEIVER,
    "q_resolve_rewrite": _G + _REWRITE + "SELECT project, type, src_label, src_key, dst_label, dst_key, args, resolved, confidence, first_seen_ord FROM rw",
    "q_orphans_rewritten": _G + _REWRITE + """SELECT project, key FROM n WHERE label = 'Symbol' AND starts_with(key, 'name::') AND invalid_sha IS NULL
        AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.project = n.project AND rw.dst_key = n.key AND rw.dst_label = 'Symbol' AND rw.invalid_sha IS NULL AND rw.type IN ('CALLS', 'INJECTS', 'REFERENCES'))""",
    "q_alias_edges": _G + _ALIAS + "SELECT DISTINCT e.project, e.src_key AS file, alias FROM e JOIN al ON al.project = e.project AND al.file = e.dst_key WHERE e.type = 'IMPORTS' AND e.dst_label = 'File' AND e.invalid_sha IS NULL AND alias <> e.dst_key",
    "q_orphans": _G + "SELECT project, key FROM n WHERE label = 'Symbol' AND starts_with(key, 'name::') AND invalid_sha IS NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.project = n.project AND e.dst_key = n.key AND e.dst_label = 'Symbol' AND e.invalid_sha IS NULL AND e.type IN ('CALLS', 'INJECTS', 'REFERENCES'))",
    "q_import_alias": _G + _ALIAS + "SELECT * FROM al",
    "q_file_project": _G + """,
f AS (SELECT project, key AS file FROM n WHERE label = 'File' AND invalid_sha IS NULL),
dr AS (SELECT DISTINCT project, array_to_string(string_split(file, '/')[1:i], '/') AS root FROM (SELECT project, file, unnest(range(1, len(string_split(file, '/')))) AS i FROM f)),
rt AS (SELECT dr.project, root FROM dr JOIN f ON f.project = dr.project AND starts_with(f.file, root || '/') GROUP BY ALL HAVING count(*) >= 3)
SELECT f.project, file, arg_max(root, length(root)) AS root FROM f JOIN rt ON f.project = rt.project AND starts_with(f.file, rt.root || '/') GROUP BY ALL""",
}
