"""Full graph snapshots: their order, what changed between them, and references to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.runtime import bounded_broadcast, cut
from stratagraph.sources.tables import canonical_json

#: Rows of nodes and edges for each slice of a project: what one task numbers, compresses and matches.
ROWS_PER_SLICE = 200_000


def snapshot_order(manifest: DataFrame, nodes: DataFrame) -> DataFrame:
    """Snapshots of each project in order: project, head_sha, created_at, idx (from 1), next_sha.

    A head_sha listed more than once counts at its smallest created_at; ties go by head_sha. One without rows in
    `nodes`, or without a created_at, project or head_sha, is no snapshot.
    """
    built = nodes.select("project", "head_sha").distinct()
    first = manifest.where("created_at is not null").groupBy("project", "head_sha").agg(F.min("created_at").alias("created_at"))
    in_order = W.partitionBy("project").orderBy("created_at", "head_sha")
    return (
        first.join(built, ["project", "head_sha"], "left_semi")
        .withColumn("idx", F.row_number().over(in_order))
        .withColumn("next_sha", F.lead("head_sha").over(in_order))
    )


def record_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one shape: project, head_sha, rec, rec_type, key_a, key_b, props, loaded_at. Null keys are left out."""
    node = nodes.select("project", "head_sha", F.lit("node").alias("rec"), F.col("label").alias("rec_type"), F.col("node_key").alias("key_a"), F.lit("").alias("key_b"), "props", "loaded_at")
    edge = edges.select("project", "head_sha", F.lit("edge").alias("rec"), F.col("edge_type").alias("rec_type"), F.col("src_key").alias("key_a"), F.col("dst_key").alias("key_b"), "props", "loaded_at")
    return node.unionByName(edge).where("rec_type is not null and key_a is not null and key_b is not null")


def snapshot_diff(records: DataFrame, order: DataFrame) -> DataFrame:
    """Records added, removed or changed from each snapshot to the next of its project.

    records: as record_rows() has them. order: as snapshot_order() has it. Returns head_sha (of the newer snapshot), rec,
    rec_type, key_a, key_b, diff_kind.

    One window over each key by snapshot index: a lagging index that isn't the one before means an addition, a leading index
    that isn't the next means a removal, a lagging hash that differs a change. All rows of a key are at most a few per
    snapshot, so that no window grows with a hot dst_key or project. Repeated rows of one snapshot count once, by the
    last loaded (null loaded_at first, ties by the greater hash). Props are compared as JSON values; null props equal
    only null props. An empty input gives an empty result.
    """
    snaps = bounded_broadcast(order.select("project", "head_sha", "idx", "next_sha"))
    rows = records.select(
        "project", "head_sha", "rec", "rec_type", "key_a", "key_b",
        F.coalesce(F.xxhash64(canonical_json(F.col("props"))), F.lit(0)).alias("h"), "loaded_at",
    ).join(snaps, ["project", "head_sha"])
    key = ["project", "rec", "rec_type", "key_a", "key_b"]
    # The same partitioning and order serve both windows: one exchange, one sort.
    w = W.partitionBy(*key).orderBy("idx", F.col("loaded_at").asc_nulls_first(), "h")
    last = rows.withColumn("following", F.lead("idx").over(w)).where("following is null or following <> idx")
    seen = last.withColumn("before", F.lag("idx").over(w)).withColumn("before_h", F.lag("h").over(w))
    came = F.when((F.col("idx") > 1) & ~F.col("before").eqNullSafe(F.col("idx") - 1), F.lit("added")).when((F.col("before") == F.col("idx") - 1) & (F.col("before_h") != F.col("h")), F.lit("changed"))
    went = F.when(F.col("next_sha").isNotNull() & ~F.col("following").eqNullSafe(F.col("idx") + 1), F.lit("removed"))
    events = F.array(F.struct(F.col("head_sha").alias("head_sha"), came.alias("diff_kind")), F.struct(F.col("next_sha").alias("head_sha"), went.alias("diff_kind")))
    return (
        seen.select("rec", "rec_type", "key_a", "key_b", F.explode(F.filter(events, lambda e: e["diff_kind"].isNotNull())).alias("e"))
        .select("e.head_sha", "rec", "rec_type", "key_a", "key_b", "e.diff_kind")
    )


def project_slices(nodes: DataFrame, edges: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """project, slices: into how many slices the keys of a project are split, in proportion to its rows."""
    rows = nodes.select("project").unionByName(edges.select("project")).where("project is not null")
    return rows.groupBy("project").agg(F.ceil(F.count("*") / rows_per_slice).cast("int").alias("slices"))


def key_occurrences(nodes: DataFrame, edges: DataFrame, slices: DataFrame) -> DataFrame:
    """project, slice, head_sha, label, key, parent, kid: each key of a snapshot once as a node's (parent) and once as a reference.

    kid is the key's integer: its rank among all keys of the project's slice, over all snapshots, so that a key has the
    same integer everywhere. Rows are made distinct with map-side combining, so a hot key is one row a snapshot. Null
    projects, snapshots and keys are left out; a null label is one of its own.
    """
    parent = nodes.select("project", "head_sha", "label", F.col("node_key").alias("key"), F.lit(True).alias("parent"))
    side = lambda s: edges.select("project", "head_sha", F.col(f"{s}_label").alias("label"), F.col(f"{s}_key").alias("key"), F.lit(False).alias("parent"))
    rows = parent.unionByName(side("src")).unionByName(side("dst")).where("project is not null and head_sha is not null and key is not null")
    rows = rows.withColumn("label", F.coalesce("label", F.lit("\u0000"))).join(slices, "project")
    sliced = rows.select("project", F.pmod(F.xxhash64("label", "key"), F.col("slices")).cast("int").alias("slice"), "head_sha", "label", "key", "parent").distinct()
    return sliced.repartition("project", "slice").withColumn("kid", F.dense_rank().over(W.partitionBy("project", "slice").orderBy("label", "key")))


def parent_runs(keys: DataFrame) -> DataFrame:
    """project, slice, head_sha, run_start, run_end, n: the integers of each snapshot's nodes, compressed into contiguous runs."""
    at = W.partitionBy("project", "slice", "head_sha").orderBy("kid")
    # Along the sorted integers, an integer less its position is the same within a run and greater in the next.
    run = F.col("kid") - F.row_number().over(at)
    parents = keys.where("parent").select("project", "slice", "head_sha", "kid").withColumn("run", run)
    return parents.groupBy("project", "slice", "head_sha", "run").agg(F.min("kid").alias("run_start"), F.max("kid").alias("run_end"), F.count("*").alias("n")).drop("run")


def orphan_keys(nodes: DataFrame, edges: DataFrame, slices: DataFrame) -> DataFrame:
    """Distinct (project, head_sha, label, key) that edges refer to and no node of that snapshot has.

    1. A dictionary over all snapshots gives every (project, label, key) an integer (key_occurrences()).
    2. The sorted integers of a snapshot's nodes become runs (parent_runs()). References don't take part in that, and as
       a snapshot has most of its project's keys, runs are few.
    3. A reference is as-of matched to the last run that starts at or before it; without one, or beyond its end, it is an
       orphan.
    All steps share the exchange on (project, slice), and a slice has about ROWS_PER_SLICE rows at most.
    """
    keys = key_occurrences(nodes, edges, slices)
    place = ["project", "slice", "head_sha"]
    runs = parent_runs(keys).select(*place, F.col("run_start").alias("at"), F.lit(0).alias("what"), "run_end", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("key"))
    refs = keys.where("not parent").select(*place, F.col("kid").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("int").alias("run_end"), "label", "key")
    so_far = W.partitionBy(*place).orderBy("at", "what").rowsBetween(W.unboundedPreceding, 0)
    matched = runs.unionByName(refs).withColumn("end", F.last("run_end", True).over(so_far))
    return matched.where("what = 1 and (end is null or at > end)").select("project", "head_sha", "label", "key")


def orphan_references(nodes: DataFrame, edges: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Edges whose source or target is no node of their snapshot: project, head_sha, edge_type, src_key, dst_key, side.

    One row per distinct edge key and side. Edges with a null dst_key, src_key, edge_type, project or head_sha are no
    references and don't count; a null label on a side never names a node, so the edge counts. Node rows with a null
    part name nothing. Extra columns are ignored; repeated and late rows count once. Edges are matched with the orphan keys
    in as many salts as their project has slices, so that a key with a third of all edges is read by as many tasks.
    """
    usable = edges.where("dst_key is not null and src_key is not null and edge_type is not null and project is not null and head_sha is not null")
    slices = bounded_broadcast(cut(project_slices(nodes, usable, rows_per_slice)))
    lost = orphan_keys(nodes, usable, slices).join(slices, "project").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def refs(side: str) -> DataFrame:
        return usable.select(
            "project", "head_sha", "edge_type", "src_key", "dst_key", F.lit(side).alias("side"),
            F.coalesce(f"{side}_label", F.lit("\u0000")).alias("label"), F.col(f"{side}_key").alias("key"),
        )

    salted = refs("src").unionByName(refs("dst")).join(slices, "project").withColumn("salt", F.pmod(F.xxhash64("edge_type", "src_key", "dst_key"), F.col("slices")).cast("int"))
    found = salted.join(lost, ["project", "head_sha", "label", "key", "salt"], "left_semi")
    return found.select("project", "head_sha", "edge_type", "src_key", "dst_key", "side").distinct()


def orphan_report(found: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Orphans and all references per edge type, side and month of the snapshot ('unknown' without a created_at)."""
    month = manifest.groupBy("project", "head_sha").agg(F.date_format(F.timestamp_seconds(F.min("created_at")), "yyyy-MM").alias("month"))
    usable = edges.where("dst_key is not null and src_key is not null and edge_type is not null and project is not null and head_sha is not null")
    per_snapshot = usable.select("project", "head_sha", "edge_type", "src_key", "dst_key").distinct().groupBy("project", "head_sha", "edge_type").agg(F.count("*").alias("n_edges"))
    sides = per_snapshot.withColumn("side", F.explode(F.array(F.lit("src"), F.lit("dst"))))
    lost = found.groupBy("project", "head_sha", "edge_type", "side").agg(F.count("*").alias("n_orphans"))
    return (
        sides.join(lost, ["project", "head_sha", "edge_type", "side"], "left")
        .join(month, ["project", "head_sha"], "left")
        .groupBy("edge_type", "side", F.coalesce("month", F.lit("unknown")).alias("month"))
        .agg(F.sum("n_edges").alias("n_edges"), F.coalesce(F.sum("n_orphans"), F.lit(0)).cast("long").alias("n_orphans"))
    )
