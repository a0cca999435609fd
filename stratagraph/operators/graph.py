"""The time-stamped code graph: lifecycle tables, topology and time-travel queries, tombstones and vacuum.

Nodes are (project, label, key), edges (project, type, src_label, src_key, dst_label, dst_key). Both carry the ordinals
of the snapshots between which they were seen: first_seen_ord, last_seen_ord and, if the project went on without them,
invalid_ord. Queries take a DataFrame of names (project, name) instead of one name, so that any number of lookups is one
join per hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.runtime import bounded_broadcast, cut, salted_join

NODE = ["project", "label", "key"]
EDGE = ["project", "type", "src_label", "src_key", "dst_label", "dst_key"]
#: Hops a multi-hop query may take.
MAX_DEPTH = 3

_NODE_PROPS = "name string, kind string, file string, start int, end int, params int, lang string, generated boolean, lines int, unresolved boolean"
_EDGE_PROPS = "args int, receiver_type string, unresolved boolean, resolved boolean, confidence string, relative boolean, derived boolean"


def parse_nodes(graph_nodes: DataFrame) -> DataFrame:
    """Snapshot rows of nodes with their props as columns."""
    return graph_nodes.where("label is not null and node_key is not null").select("project", "head_sha", "label", F.col("node_key").alias("key"), "loaded_at", F.from_json("props", _NODE_PROPS).alias("p")).select("project", "head_sha", "label", "key", "loaded_at", "p.*")


def parse_edges(graph_edges: DataFrame) -> DataFrame:
    """Snapshot rows of edges with their props as columns; rows with a null key are left out."""
    rows = graph_edges.where("edge_type is not null and src_key is not null and dst_key is not null")
    return rows.select("project", "head_sha", F.col("edge_type").alias("type"), "src_label", "src_key", "dst_label", "dst_key", "loaded_at", F.from_json("props", _EDGE_PROPS).alias("p")).select("project", "head_sha", "type", "src_label", "src_key", "dst_label", "dst_key", "loaded_at", "p.*")


def lifecycle(rows: DataFrame, order: DataFrame, key: list[str]) -> DataFrame:
    """Upserts all snapshots at once: one row per key, first and last seen, and the tombstone where later snapshots lack it.

    The first sighting is kept, the last one advances, props are merged with new values winning and absent ones kept, and a
    key seen again is alive again. order: as operators.snapshots.snapshot_order() has it.
    """
    order = bounded_broadcast(order)
    dated = rows.join(order.select("project", "head_sha", "idx", "created_at"), ["project", "head_sha"])
    at = F.struct("idx", "loaded_at")
    props = [c for c in rows.columns if c not in {*key, "head_sha", "loaded_at"}]
    merged = dated.groupBy(*key).agg(
        F.min("idx").cast("long").alias("first_seen_ord"), F.min_by("head_sha", "idx").alias("first_seen_sha"),
        F.max("idx").cast("long").alias("last_seen_ord"), F.max_by("head_sha", "idx").alias("last_seen_sha"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in props],
    )
    after = order.select("project", (F.col("idx") - 1).cast("long").alias("last_seen_ord"), F.col("head_sha").alias("invalid_sha"), F.col("idx").cast("long").alias("invalid_ord"), F.col("created_at").alias("invalid_at"))
    return merged.join(after, ["project", "last_seen_ord"], "left")


def heads(order: DataFrame) -> DataFrame:
    """project, head_sha, head_ord of each project's last snapshot."""
    return order.where("next_sha is null").select("project", "head_sha", F.col("idx").cast("long").alias("head_ord"))


def live(df: DataFrame) -> DataFrame:
    return df.where("invalid_sha is null")


def alive_at(df: DataFrame, ordinal: int, prefix: str = "") -> DataFrame:
    """Rows alive at a commit ordinal; the interval is half open, and a row without a first sighting is left out."""
    return df.where(f"{prefix}first_seen_ord <= {int(ordinal)} and ({prefix}invalid_ord is null or {prefix}invalid_ord > {int(ordinal)})")


def symbols(nodes: DataFrame, only_live: bool = True) -> DataFrame:
    """Symbols that are resolved (no placeholders) and, by default, live."""
    s = nodes.where("label = 'Symbol' and unresolved is null")
    return live(s) if only_live else s


def live_files(df: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Rows whose file (project, column) isn't tombstoned. A file that is only known as an end of edges is live."""
    dead = nodes.where("label = 'File' and invalid_sha is not null").select("project", F.col("key").alias(column))
    return df.join(dead, ["project", column], "left_anti")


def _defines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, file, key: the symbols that live files define. An edge's tombstone isn't looked at."""
    d = edges.where("type = 'DEFINES' and src_label = 'File' and dst_label = 'Symbol'").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("key"))
    return live_files(d, nodes, "file")


def _asked(nodes: DataFrame, names: DataFrame | None) -> DataFrame:
    return nodes if names is None else nodes.join(names, ["project", "name"], "left_semi")


def definitions(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """project, name, file, start, end, kind of the symbols with the asked names (all names if None) that live files define."""
    s = _asked(symbols(nodes), names)
    return s.join(_defines(nodes, edges).withColumnRenamed("file", "def_file"), ["project", "key"]).select("project", "name", F.col("def_file").alias("file"), "start", "end", "kind")


def callers(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None, live_edges: bool = False) -> DataFrame:
    """project, name, caller, target_file, target_start, target_end, target_kind: live files that call or refer to a symbol.

    As in the reference an edge's tombstone isn't looked at, unless live_edges. Calls and references of a file to one symbol
    are one row before they meet it, and the files of a symbol are spread over tasks.
    """
    s = _asked(symbols(nodes), names)
    e = (live(edges) if live_edges else edges).where("type in ('CALLS', 'REFERENCES') and src_label = 'File' and dst_label = 'Symbol'")
    once = live_files(e.select("project", F.col("src_key").alias("caller"), F.col("dst_key").alias("key")).distinct(), nodes, "caller")
    targets = s.select("project", "key", "name", F.col("file").alias("target_file"), F.col("start").alias("target_start"), F.col("end").alias("target_end"), F.col("kind").alias("target_kind"))
    return salted_join(once, targets, ["project", "key"], ["caller"]).select("project", "name", "caller", "target_file", "target_start", "target_end", "target_kind").distinct()


def defines_at(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """project, file, name: distinct names of live symbols that the given (project, file) define, if these are live."""
    d = _defines(nodes, edges).join(files, ["project", "file"], "left_semi")
    return d.join(symbols(nodes).select("project", "key", "name"), ["project", "key"]).where("name is not null").select("project", "file", "name").distinct()


def slim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What topology queries read of nodes and edges, cut once for all hops."""
    n = nodes.where("label in ('File', 'Symbol', 'Type')").select(*NODE, "name", "kind", "file", "start", "end", "unresolved", "invalid_sha")
    return cut(n), cut(edges.where("type in ('DEFINES', 'CALLS', 'REFERENCES')").select(*EDGE, "invalid_sha"))


def callers_multi(nodes: DataFrame, edges: DataFrame, names: DataFrame, depth: int) -> DataFrame:
    """Callers up to `depth` hops (1 to 3): root, caller, hop and the target's columns; one row per root and caller file.

    names: project, name. Each ring is two joins: the callers of the ring's names, and the names that new caller files
    define. Names and files met before are left out; the first ring wins, then the least target file, start, end and name.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    ring = names.select("project", F.col("name").alias("root"), "name").distinct()
    seen_names, seen_files, parts = ring, None, []
    for hop in range(1, depth + 1):
        found = callers(nodes, edges, ring.select("project", "name")).join(ring, ["project", "name"])
        if seen_files is not None:
            found = found.join(seen_files, ["project", "root", "caller"], "left_anti")
        w = W.partitionBy("project", "root", "caller").orderBy("target_file", "target_start", "target_end", "name")
        found = cut(found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("hop", F.lit(hop)))
        parts.append(found)
        files = found.select("project", "root", "caller")
        seen_files = files if seen_files is None else seen_files.unionByName(files)
        if hop < depth:
            defined = defines_at(nodes, edges, files.select("project", F.col("caller").alias("file")).distinct())
            nxt = files.withColumnRenamed("caller", "file").join(defined, ["project", "file"]).select("project", "root", "name").distinct()
            ring = cut(nxt.join(seen_names, ["project", "root", "name"], "left_anti"))
            seen_names = seen_names.unionByName(ring)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("project", "root", "caller", "hop", "name", "target_file", "target_start", "target_end", "target_kind")


def _owners(nodes: DataFrame, edges: DataFrame, names: DataFrame | None) -> DataFrame:
    """project, symbol, src: the live files that define a live symbol of an asked name."""
    s = _asked(live(nodes.where("label = 'Symbol'")), names).select("project", "key", F.col("name").alias("symbol"))
    return _defines(nodes, edges).join(s, ["project", "key"]).select("project", "symbol", F.col("file").alias("src")).distinct()


def _called(nodes: DataFrame, edges: DataFrame, type_: str, labels: tuple[str, ...]) -> DataFrame:
    """project, src, label, key, name, file, start, end, kind, resolved: the live targets of the edges of a type from live files, once each."""
    e = edges.where((F.col("type") == type_) & (F.col("src_label") == "File") & F.col("dst_label").isin(*labels))
    once = live_files(e.select("project", F.col("src_key").alias("src"), F.col("dst_label").alias("label"), F.col("dst_key").alias("key")).distinct(), nodes, "src")
    targets = live(nodes.where(F.col("label").isin(*labels))).select(*NODE, "name", "file", "start", "end", "kind", F.col("unresolved").isNull().alias("resolved"))
    return salted_join(once, targets, NODE, ["src"])


def callees(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """project, symbol, name, key, file, start, end, kind, resolved, label: what the files that define a symbol call.

    Files, symbols and targets are live; the calls are joined to their targets before they are spread over the symbols of
    their files.
    """
    called = _called(nodes, edges, "CALLS", ("Symbol", "Type"))
    return _owners(nodes, edges, names).join(called, ["project", "src"]).select("project", "symbol", "name", "key", "file", "start", "end", "kind", "resolved", "label").distinct()


def callees_multi(nodes: DataFrame, edges: DataFrame, names: DataFrame, depth: int) -> DataFrame:
    """Callees up to `depth` hops: root, hop, name, file, label, resolved; each (name, file) once per root, at its first hop.

    The first ring are the files that define the root; the next ones are the files of the callees that are new, resolved and
    have a file: from there on all calls of these files count.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    roots = names.select("project", "name").distinct()
    ring = _owners(nodes, edges, roots).select("project", F.col("symbol").alias("root"), "src")
    called = _called(nodes, edges, "CALLS", ("Symbol", "Type"))
    seen_files, out = ring, None
    for hop in range(1, depth + 1):
        found = ring.join(called, ["project", "src"]).groupBy("project", "root", "name", "file").agg(F.min("label").alias("label"), F.bool_or("resolved").alias("resolved")).withColumn("hop", F.lit(hop))
        if out is not None:
            seen = out.select("project", "root", F.col("name").alias("n"), F.col("file").alias("f"))
            same = (F.col("a.project") == F.col("b.project")) & (F.col("a.root") == F.col("b.root")) & F.col("a.name").eqNullSafe(F.col("b.n")) & F.col("a.file").eqNullSafe(F.col("b.f"))
            found = found.alias("a").join(seen.alias("b"), same, "left_anti")
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        if hop < depth:
            ring = cut(found.where("resolved and file is not null").select("project", "root", F.col("file").alias("src")).distinct().join(seen_files, ["project", "root", "src"], "left_anti"))
            seen_files = seen_files.unionByName(ring)
    return out.select("project", "root", "hop", "name", "file", "label", "resolved")


def injects(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """project, symbol, name, key, file, kind, resolved: what the live files that define a live symbol have injected."""
    called = _called(nodes, edges, "INJECTS", ("Symbol", "Type"))
    return _owners(nodes, edges, names).join(called, ["project", "src"]).select("project", "symbol", "name", "key", "file", "kind", "resolved").distinct()


def injectors(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """project, token, file: live files that have a live token injected, resolved or not."""
    s = live(nodes.where("label = 'Symbol' and name is not null")).select("project", "key", F.col("name").alias("token"))
    s = s if names is None else s.join(names.select("project", F.col("name").alias("token")), ["project", "token"], "left_semi")
    i = edges.where("type = 'INJECTS' and src_label = 'File' and dst_label = 'Symbol'").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("key")).distinct()
    return salted_join(live_files(i, nodes, "file"), s, ["project", "key"], ["file"]).select("project", "token", "file").distinct()


def importers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, file, module of live imports of modules by live files."""
    return live_files(live(edges).where("type = 'IMPORTS' and src_label = 'File' and dst_label = 'Module'").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("module")).distinct(), nodes, "file")


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, file, module of all imports of live modules by live files.

    A module imports nothing, but a file may import files, so more hops would go on from those; one hop is what counts here.
    """
    i = edges.where("type = 'IMPORTS' and src_label = 'File' and dst_label = 'Module'").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("module")).distinct()
    dead = nodes.where("label = 'Module' and invalid_sha is not null").select("project", F.col("key").alias("module"))
    return salted_join(live_files(i, nodes, "file"), dead, ["project", "module"], ["file"], "left_anti").select("project", "file", "module")


def neighbors(edges: DataFrame, start: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """project, label, key reachable from start (project, label, key) over edges in either direction, the start left out."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    there = e.select("project", F.col("src_label").alias("label"), F.col("src_key").alias("key"), F.col("dst_label").alias("to_label"), F.col("dst_key").alias("to_key"))
    both = there.unionByName(there.select("project", F.col("to_label").alias("label"), F.col("to_key").alias("key"), F.col("label").alias("to_label"), F.col("key").alias("to_key")))
    seen = start.select(*NODE).distinct()
    ring = seen
    for _ in range(max(1, min(depth, MAX_DEPTH))):
        nxt = salted_join(both, ring, NODE, ["to_label", "to_key"], "left_semi").select("project", F.col("to_label").alias("label"), F.col("to_key").alias("key")).distinct()
        ring = cut(nxt.join(seen, NODE, "left_anti"))
        seen = seen.unionByName(ring)
    return seen.join(start, NODE, "left_anti")


def callers_at(nodes: DataFrame, edges: DataFrame, ordinal: int) -> DataFrame:
    """callers() as it was at a commit ordinal: symbol, caller file and edge alive then. Rows aren't reduced per file."""
    s = alive_at(symbols(nodes, only_live=False), ordinal).select("project", "key", "name", F.col("file").alias("target_file"), F.col("start").alias("target_start"), F.col("end").alias("target_end"), F.col("kind").alias("target_kind"))
    f = alive_at(nodes.where("label = 'File'"), ordinal).select("project", F.col("key").alias("caller"))
    e = alive_at(edges.where("type in ('CALLS', 'REFERENCES') and src_label = 'File' and dst_label = 'Symbol'"), ordinal).select("project", F.col("src_key").alias("caller"), F.col("dst_key").alias("key"))
    return salted_join(e.distinct().join(f, ["project", "caller"], "left_semi"), s, ["project", "key"], ["caller"]).select("project", "name", "caller", "target_file", "target_start", "target_end", "target_kind").distinct()


def drift(nodes: DataFrame, head: DataFrame) -> DataFrame:
    """project, key, name, file, last_seen_sha, invalid_sha, status of resolved symbols that aren't at their project's head."""
    s = symbols(nodes, only_live=False).join(bounded_broadcast(head.select("project", "head_sha")), "project")
    status = F.when(F.col("invalid_sha").isNotNull(), "tombstoned").when(F.col("last_seen_sha") != F.col("head_sha"), "drifted")
    return s.withColumn("status", status).where("status is not null").select("project", "key", "name", "file", "last_seen_sha", "invalid_sha", "status")


def upsert(old: DataFrame, new: DataFrame, key: list[str], sha: str | None, ordinal: int | None) -> DataFrame:
    """Merges a batch into a lifecycle table: first sighting kept, last advanced, props merged, the tombstone taken away.

    Without a sha only the props are merged and the stamps stay as they are. new has the key and any of old's other
    columns; a key given twice in one batch counts once.
    """
    stamps = {"first_seen_sha", "first_seen_ord", "last_seen_sha", "last_seen_ord", "invalid_sha", "invalid_ord", "invalid_at"}
    incoming = new.drop_duplicates(key)
    props = [c for c in incoming.columns if c not in {*key, *stamps}]
    renamed = incoming.select(*key, *[F.col(c).alias(f"_{c}") for c in props], F.lit(True).alias("_new"))
    both = old.join(renamed, key, "full_outer")
    is_new = F.col("_new").isNotNull()

    def column(c: str):  # noqa: ANN202
        if c in key:
            return F.col(c)
        if c in props:
            return F.coalesce(f"_{c}", c).alias(c)
        if sha is None or c not in stamps:
            return F.col(c)
        value = {"first_seen_sha": F.coalesce(c, F.lit(sha)), "first_seen_ord": F.coalesce(c, F.lit(ordinal)), "last_seen_sha": F.lit(sha), "last_seen_ord": F.lit(ordinal)}.get(c, F.lit(None))
        return F.when(is_new, value).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c)

    return both.select(*[column(c) for c in old.columns])


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, label, key of edge ends that aren't nodes: an edge upsert creates them without stamps."""
    ends = edges.select("project", F.col("src_label").alias("label"), F.col("src_key").alias("key")).unionByName(edges.select("project", F.col("dst_label").alias("label"), F.col("dst_key").alias("key")))
    return ends.distinct().join(nodes, NODE, "left_anti")


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, sha: str, ordinal: int, at: float) -> tuple[DataFrame, DataFrame]:
    """Tombstones files (project, file), the resolved symbols they define, and every edge that touches either."""
    d = edges.where("type = 'DEFINES' and src_label = 'File' and dst_label = 'Symbol'").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("key"))
    defined = d.join(files, ["project", "file"], "left_semi").join(symbols(nodes, only_live=False).select("project", "key"), ["project", "key"], "left_semi").select("project", F.lit("Symbol").alias("label"), "key")
    gone = cut(files.select("project", F.lit("File").alias("label"), F.col("file").alias("key")).unionByName(defined).distinct())
    stamp = {"invalid_sha": F.lit(sha), "invalid_ord": F.lit(ordinal).cast("long"), "invalid_at": F.lit(at)}

    def mark(df: DataFrame) -> DataFrame:
        return df.select(*[F.when(F.col("_gone"), stamp[c]).otherwise(F.col(c)).alias(c) if c in stamp else F.col(c) for c in df.columns if c != "_gone"])

    marked = gone.withColumn("_g", F.lit(True))
    n = nodes.join(marked, NODE, "left").withColumn("_gone", F.col("_g").isNotNull()).drop("_g")
    src = marked.select("project", F.col("label").alias("src_label"), F.col("key").alias("src_key"), F.col("_g").alias("_s"))
    dst = marked.select("project", F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.col("_g").alias("_d"))
    e = salted_join(salted_join(edges, src, ["project", "src_label", "src_key"], ["dst_key"], "left"), dst, ["project", "dst_label", "dst_key"], ["src_key"], "left").withColumn("_gone", F.coalesce("_s", "_d").isNotNull()).drop("_s", "_d")
    return mark(n), mark(e)


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes files (project, file) and every edge that touches them out, without a trace; what they defined stays."""
    gone = files.select("project", F.lit("File").alias("label"), F.col("file").alias("key")).distinct()
    ends = lambda s: gone.select("project", F.col("label").alias(f"{s}_label"), F.col("key").alias(f"{s}_key"))
    kept = salted_join(edges, ends("src"), ["project", "src_label", "src_key"], ["dst_key"], "left_anti")
    return nodes.join(gone, NODE, "left_anti"), salted_join(kept, ends("dst"), ["project", "dst_label", "dst_key"], ["src_key"], "left_anti").select(*edges.columns)


def vacuum(nodes: DataFrame, edges: DataFrame, *, before_ord: int | None = None, before_at: float | None = None, drop_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes tombstoned files, symbols and edges; returns nodes and edges left and the counts per project.

    Exactly one mode must be given. Each edge is counted once.
    """
    if sum([before_ord is not None, before_at is not None, drop_all]) != 1:
        raise ValueError("give exactly one of before_ord, before_at and drop_all")
    due = F.lit(True) if drop_all else (F.col("invalid_ord") <= before_ord) if before_ord is not None else (F.col("invalid_at") <= before_at)
    old = F.coalesce(F.col("invalid_sha").isNotNull() & due, F.lit(False))
    node_old = old & F.col("label").isin("File", "Symbol")
    counts = nodes.where(node_old).select("project", F.when(F.col("label") == "File", "files").otherwise("symbols").alias("what")).unionByName(edges.where(old).select("project", F.lit("edges").alias("what")))
    per = counts.groupBy("project").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("files", "symbols", "edges")])
    return nodes.where(~node_old), edges.where(~old), per


def most_called(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, name of each project's symbol name with the most calling files; ties by name."""
    n = callers(nodes, edges).groupBy("project", "name").agg(F.countDistinct("caller").alias("n"))
    return n.groupBy("project").agg(F.max_by("name", F.struct("n", "name")).alias("name"))


def busiest_file(edges: DataFrame) -> DataFrame:
    """project, label, key of each project's file with the most edges out; ties by the greater key."""
    n = edges.where("src_label = 'File'").groupBy("project", F.col("src_key").alias("key")).agg(F.count("*").alias("n"))
    return n.groupBy("project").agg(F.max_by("key", F.struct("n", "key")).alias("key")).select("project", F.lit("File").alias("label"), "key")
