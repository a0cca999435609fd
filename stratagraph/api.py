"""One object for the whole engine: lookups by name over a folder of tables, and the calls that write to them.

What is written goes to versioned tables (`name.table`) and appended rows (`name.rows`) beside the folder's Parquet tables, which
are never changed; a versioned table takes the place of the Parquet table of its name.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.text import content_hash
from stratagraph.operators import graph, ingest, memory, metrics, pack, pipeline, resolve, retrieval, snapshots
from stratagraph.runtime import cut
from stratagraph.sources.store import SnapshotStore, VersionedTable, apply_snapshot
from stratagraph.sources.tables import table

#: Columns of the tables that are written here.
EPISODES = "id string, ts double, prompt string, plan string, patch string, verdict string, tags array<string>, meta map<string,string>, head_sha string"
CLAIMS = "id string, subject string, predicate string, obj string, polarity boolean, confidence double, evidence_span string, valid_at double, valid_to double, recorded_at double, head_sha string, session_id string, entity_subject_id string"
STATE = "root string, sha string, branch string, file_count long, symbol_count long, ts double"
ROWS = {
    "retrieves": "id long, query_text string, embed_ms double, code_search_ms double, eps_search_ms double, claims_ms double, total_ms double, code_hit_count int, eps_hit_count int, claims_hit_count int, ts double",
    "backend_health": "id long, backend string, status string, latency_ms double, ts double",
    "cache_stats": "hits long, misses long, ts double",
    "ingest_stats": "files long, symbols long, duration_s double, ts double",
    "tool_calls": "tool string, project string, query_text string, output_chars long, result_count long, session_id string, ts double",
    "fs_reads": "tool string, path string, project string, output_chars long, session_id string, ts double",
}


class Memory:
    """The code graph, claims, episodes and metrics of one project, or of all projects of a folder if project is None."""

    def __init__(self, spark: SparkSession, path: str, project: str | None = None) -> None:
        if project is not None and project.strip().lower() in ("", "auto", "default"):
            raise ValueError("name a project, or none for all")
        self.spark, self.path, self.project = spark, path, project
        self._graph: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def store(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}.table")

    def has(self, name: str) -> bool:
        store = self.store(name)
        return store.exists() or any(store.files.exists(f"{self.path}/{name}.{kind}") for kind in ("parquet", "rows"))

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table as it is now: the versioned one, else the Parquet one with the rows appended since; empty if schema is given and there is none."""
        store = self.store(name)
        if store.exists():
            df = store.read()
        elif store.files.exists(f"{self.path}/{name}.parquet"):
            df = table(self.spark, self.path, name)
        elif schema is not None or name in ROWS:
            df = self.spark.createDataFrame([], schema or ROWS[name])
        else:
            raise FileNotFoundError(f"{self.path}/{name}.parquet")
        if name in ROWS and store.files.exists(f"{self.path}/{name}.rows"):
            df = df.unionByName(self.spark.read.parquet(f"{self.path}/{name}.rows"), allowMissingColumns=True)
        return df.where(F.col("project") == self.project) if self.project is not None and "project" in df.columns else df

    # Writing

    def append(self, name: str, **values: object) -> None:
        """Appends one row to a table of metrics (ROWS); what isn't given is null, ts is now, id a new one."""
        columns = [c.split()[0] for c in ROWS[name].split(", ")]
        unknown = set(values) - set(columns)
        if unknown:
            raise ValueError(f"{name} has no {sorted(unknown)}")
        row = {"ts": time.time(), "id": uuid.uuid4().int >> 66, "project": self.project} | values
        self.spark.createDataFrame([tuple(row.get(c) for c in columns)], ROWS[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}.rows")

    def record(self, prompt: str, plan: str | None = None, patch: str | None = None, verdict: str | None = None, tags: Sequence[str] = (), meta: dict[str, str] | None = None, head_sha: str | None = None, ts: float | None = None) -> str:
        """Records an episode and returns its id: a new one, or that of the episode with the same prompt, which is refreshed."""
        if not (prompt or "").strip():
            raise ValueError("a prompt is needed")
        new = self.spark.createDataFrame([(uuid.uuid4().hex, time.time() if ts is None else ts, prompt, plan or None, patch or None, verdict or None, list(tags), meta or {}, head_sha)], EPISODES)
        h = new.select(content_hash(F.col("prompt"))).first()[0]
        old = self.table("episodes", EPISODES)
        same = old.where(content_hash(F.col("prompt")) == h).select(*new.columns)
        merged = memory.episodes_dedup(same.unionByName(new))
        self.store("episodes").upsert(merged.select("content_hash", *new.columns), ["content_hash"], "ts")
        return merged.first()["id"]

    def assert_claim(self, subject: str, predicate: str, obj: str, polarity: bool = True, confidence: float = 0.95, evidence: str = "", valid_at: float | None = None, head_sha: str | None = None, session_id: str | None = None, embed: pack.Embed | None = None, threshold: float = 0.95) -> str:
        """Asserts a claim and returns its id. It is stored as it is said; with embed, one near to an open claim refreshes that one."""
        for name, x in (("subject", subject), ("predicate", predicate), ("obj", obj)):
            if not isinstance(x, str) or not x.strip():
                raise ValueError(f"a {name} is needed")
        if not isinstance(polarity, bool) or not 0 <= float(confidence) <= 1:
            raise ValueError("polarity is a boolean, confidence within 0 and 1")
        now = time.time()
        id_ = uuid.uuid4().hex
        new = self.spark.createDataFrame([(id_, subject, predicate, obj, polarity, float(confidence), evidence, now if valid_at is None else float(valid_at), None, now, head_sha, session_id, None)], CLAIMS)
        new = memory.valid_claims(new)
        if embed is not None:
            text = memory.claim_text(*[F.col(x) for x in ("subject", "predicate", "obj", "polarity", "evidence_span")])
            open_ = cut(pack.embedded(self.open_claims(), text, embed))
            mine = cut(pack.embedded(new, text, embed))
            new = pack.collapse_near(new, open_, pack.near_claims(mine, open_, threshold))
        store = self.store("claims")
        if not store.exists():
            store.replace(self.table("claims", CLAIMS).where("id is not null").select(*new.columns).dropDuplicates(["id"]), ["id"])
        store.upsert(new, ["id"], "recorded_at")
        return id_

    def set_state(self, root: str, sha: str, branch: str | None = None, file_count: int | None = None, symbol_count: int | None = None) -> None:
        """Notes the last commit that was read of a root."""
        self.store("ingest_state").upsert(self.spark.createDataFrame([(root, sha, branch, file_count, symbol_count, time.time())], STATE), ["root"], "ts")

    def state(self, root: str | None = None) -> DataFrame:
        rows = self.table("ingest_state", STATE)
        return rows if root is None else rows.where(F.col("root") == root)

    def clear_state(self, root: str) -> None:
        if self.store("ingest_state").exists():
            self.store("ingest_state").delete(self.spark.createDataFrame([(root,)], "root string"), ["root"])

    def ingest(self, files: DataFrame, sha: str, ordinal: int, deleted: DataFrame | None = None, at: float | None = None) -> DataFrame:
        """Reads files (path, text, lang, and project unless this object has one) into nodes, edges and chunks; returns the counters.

        files are those that are new or changed at the commit, deleted (project, file) those that are gone.
        """
        files = files if "project" in files.columns else files.withColumn("project", F.lit(self.project or "default"))
        began = time.time()
        read = pipeline.read_files(files)
        none = self.spark.createDataFrame([], "project string, file string")
        gone = none if deleted is None else deleted
        new_nodes, new_edges = pipeline.graph_rows(read)
        stamps = ["first_seen_sha", "first_seen_ord", "last_seen_sha", "last_seen_ord", "invalid_sha", "invalid_ord", "invalid_at"]
        kinds = ("string", "long", "string", "long", "string", "long", "double")
        empty = lambda df: df.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(stamps, kinds, strict=True)])
        old = [self.store(n).read() if self.store(n).exists() else empty(df) for n, df in (("nodes", new_nodes), ("edges", new_edges))]
        nodes, edges = pipeline.apply_change(*old, read, gone, sha, ordinal, time.time() if at is None else at)
        self.store("nodes").replace(cut(nodes), graph.NODE)
        self.store("edges").replace(cut(edges), graph.EDGE)
        chunks = cut(pipeline.chunk_rows(read).withColumn("ordinal", F.lit(ordinal)))
        kept = self.store("code_chunks")
        if kept.exists():
            touched = gone.select("project", F.col("file").alias("path")).unionByName(read.select("project", "path"))
            stale = kept.read().join(touched, ["project", "path"], "left_semi").join(chunks, ["project", "chunk_id"], "left_anti").select("project", "chunk_id")
            kept.delete(cut(stale), ["project", "chunk_id"])
        kept.upsert(chunks, ["project", "chunk_id"], "ordinal")
        seen = cut(pipeline.counters(read, chunks))
        total = seen.where("project is null").first()
        self.append("ingest_stats", files=total["files"] if total else 0, symbols=total["symbols"] if total else 0, duration_s=time.time() - began)
        self._graph = None
        return seen

    def resolve_write(self) -> DataFrame:
        """Resolves the kept edges, writes them back, drops placeholders nothing points to; returns how many edges each tier decided."""
        n, e = self.store("nodes").read(), self.store("edges").read()
        imports = e.where("type = 'IMPORTS' and dst_label = 'Module' and dst_key like '.%' and invalid_sha is null").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("module"))
        files = n.where("label = 'File' and invalid_sha is null").select("project", F.col("key").alias("path"))
        relative = cut(resolve.resolve_imports(imports, files))
        done = cut(resolve.resolve(resolve.placeholder_edges(n, e), resolve.definition_index(n, e), relative.select("project", "file", "target"), resolve.assembly_types(n, e)))
        new = resolve.rewrite(e, done)
        alias = resolve.alias_edges(relative, resolve.import_aliases(n)).select("project", F.lit("IMPORTS").alias("type"), F.lit("File").alias("src_label"), F.col("file").alias("src_key"), F.lit("Module").alias("dst_label"), F.col("alias").alias("dst_key"))
        new = cut(graph.upsert(new, alias, graph.EDGE, None, None))
        self.store("edges").replace(new, graph.EDGE)
        orphans = resolve.orphan_placeholders(n, new).select("project", F.lit("Symbol").alias("label"), "key")
        self.store("nodes").delete(cut(orphans), graph.NODE)
        self._graph = None
        return done.groupBy("type", "tier").agg(F.count("*").alias("n"))

    def snapshot(self, root: str, project: str, sha: str, **manifest: object) -> dict:
        """Writes the kept nodes, edges and chunks of a project as the snapshot of a commit."""
        tables = {n: self.store(n).read().where(F.col("project") == project) for n in ("nodes", "edges", "code_chunks")}
        return SnapshotStore(self.spark, root).write(project, sha, tables, **({"created_at": time.time()} | manifest))

    def restore(self, root: str, project: str, sha: str) -> str:
        """Replaces what is kept by a snapshot; '' or why it was refused."""
        keys = {"nodes": graph.NODE, "edges": graph.EDGE, "code_chunks": ["project", "chunk_id"]}
        reason = apply_snapshot(self.spark, SnapshotStore(self.spark, root).path(project, sha), {n: (self.store(n), k) for n, k in keys.items()})
        self._graph = None if not reason else self._graph
        return reason

    def reset(self, names: Sequence[str] | None = None) -> list[str]:
        """Deletes what was written here (all of it, or the given names), not the folder's Parquet tables; returns what is gone."""
        files, gone = self.store("x").files, []
        for f in files.list(self.path):
            name, _, kind = f.rpartition(".")
            if kind in ("table", "rows") and (names is None or name in names):
                files.delete(f"{self.path}/{f}")
                gone.append(name)
        self._graph = None
        return sorted(gone)

    # Reading

    @property
    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes and edges with their lifecycles, and the order of snapshots: the kept ones, or built once from all snapshots."""
        if self._graph is None and self.store("nodes").exists():
            only = lambda df: df.where(F.col("project") == self.project) if self.project is not None else df
            n, e = only(self.store("nodes").read()), only(self.store("edges").read())
            order = n.where("last_seen_ord is not null").groupBy("project").agg(F.max(F.struct("last_seen_ord", "last_seen_sha")).alias("m"))
            self._graph = n, e, order.select("project", F.col("m.last_seen_sha").alias("head_sha"), F.lit(None).cast("double").alias("created_at"), F.col("m.last_seen_ord").cast("int").alias("idx"), F.lit(None).cast("string").alias("next_sha"))
        if self._graph is None:
            nodes = self.table("graph_nodes")
            order = cut(snapshots.snapshot_order(self.table("snapshot_manifest"), nodes))
            n = graph.lifecycle(graph.parse_nodes(nodes), order, graph.NODE)
            e = graph.lifecycle(graph.parse_edges(self.table("graph_edges")), order, graph.EDGE)
            self._graph = cut(n), cut(e), order
        return self._graph

    def _names(self, name: str) -> DataFrame:
        return self.graph[0].where(F.col("name") == name).select("project", "name").distinct()

    def definitions(self, name: str) -> DataFrame:
        return graph.definitions(*self.graph[:2], self._names(name))

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return graph.callers_multi(*self.graph[:2], self._names(name), depth)

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return graph.callees(*self.graph[:2], self._names(name)) if depth == 1 else graph.callees_multi(*self.graph[:2], self._names(name), depth)

    def injects(self, name: str) -> DataFrame:
        return graph.injects(*self.graph[:2], self._names(name))

    def injectors(self, token: str) -> DataFrame:
        return graph.injectors(*self.graph[:2], self._names(token))

    def importers(self, module: str) -> DataFrame:
        return graph.importers(*self.graph[:2]).where(F.col("module") == module)

    def dependencies(self, file: str) -> DataFrame:
        return graph.dependencies(*self.graph[:2]).where(F.col("file") == file)

    def neighbors(self, label: str, key: str, depth: int = 1, types: list[str] | None = None) -> DataFrame:
        start = self.graph[0].where((F.col("label") == label) & (F.col("key") == key)).select(*graph.NODE)
        return graph.neighbors(self.graph[1], start, depth, types)

    def at_sha(self, ordinal: int, label: str = "Symbol") -> DataFrame:
        if label not in ("Symbol", "File"):
            raise ValueError("label must be Symbol or File")
        return graph.alive_at(self.graph[0].where(F.col("label") == label), ordinal)

    def callers_at_sha(self, name: str, ordinal: int) -> DataFrame:
        return graph.callers_at(*self.graph[:2], ordinal).where(F.col("name") == name)

    def drift(self) -> DataFrame:
        return graph.drift(self.graph[0], graph.heads(self.graph[2]))

    def vacuum(self, **mode) -> DataFrame:  # noqa: ANN003
        return graph.vacuum(*self.graph[:2], **mode)[2]

    def resolve(self) -> DataFrame:
        n, e, _ = self.graph
        return resolve.resolve(resolve.placeholder_edges(n, e), resolve.definition_index(n, e), resolve.relative_imports(e))

    def orphans(self) -> DataFrame:
        return snapshots.orphan_references(self.table("graph_nodes"), self.table("graph_edges"))

    def changes(self) -> DataFrame:
        nodes = self.table("graph_nodes")
        return snapshots.snapshot_diff(snapshots.record_rows(nodes, self.table("graph_edges")), snapshots.snapshot_order(self.table("snapshot_manifest"), nodes))

    def claims(self, subject: str | None = None, as_of: float | None = None, limit: int | None = 50) -> DataFrame:
        history = memory.claim_history(memory.valid_claims(self.table("claims", CLAIMS)))
        rows = memory.current(history) if as_of is None else memory.as_of(history, as_of)
        rows = rows if subject is None else rows.where(F.col("subject") == subject.strip())
        ordered = rows.orderBy(F.desc("valid_at"), "subject", "predicate", "obj")
        return ordered if limit is None else ordered.limit(limit)

    def open_claims(self) -> DataFrame:
        """The open claims, each id once."""
        history = memory.current(memory.claim_history(memory.valid_claims(self.table("claims", CLAIMS))))
        return history.groupBy("id").agg(F.min(F.struct("subject", "predicate", "obj", "polarity", "confidence", "evidence_span", "valid_at", "recorded_at", "head_sha")).alias("r")).select("id", "r.*")

    def code(self) -> DataFrame:
        """Current code chunks in the shape that retrieve() takes: the kept ones, else those of the chunks table."""
        columns = ["path", "start", "end", "kind", "name", "text", "generated"]
        if self.store("code_chunks").exists():
            rows = self.store("code_chunks").read()
            return (rows if self.project is None else rows.where(F.col("project") == self.project)).select(F.concat_ws("/", "project", "chunk_id").alias("id"), *columns)
        cols = ["project", "file_path", "start_line", "end_line", "kind", "sym_name", "text"]
        c = self.table("chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(*cols), F.struct("indexed_at", "text")).alias("r")).select("chunk_id", "r.*").where("text is not null")
        return c.select(F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), "kind", F.col("sym_name").alias("name"), "text", ingest.looks_generated(F.col("file_path"), F.col("text")).alias("generated"))

    def retrieve(self, question: str | DataFrame, embed: pack.Embed | None = None, now: float | None = None, **options: object) -> DataFrame:
        """Code, episodes and claims for a question, or for a DataFrame of them (query): pack.retrieve() over this folder.

        embed maps a text column to a vector column; without it hashed words stand in for a model. pack.pack_json() and
        pack.render() turn the result into objects and texts.
        """
        asked = self.spark.createDataFrame([(question,)], "query string") if isinstance(question, str) else question
        embed = embed or retrieval.embed_udf(retrieval.HashingEmbedder(), 64)
        claims = self.open_claims() if self.has("claims") else None
        return pack.retrieve(asked, self.code(), self.table("episodes", EPISODES), claims, time.time() if now is None else now, embed, **options)

    def recent_episodes(self, limit: int = 20) -> DataFrame:
        return self.table("episodes", EPISODES).orderBy(F.desc("ts"), F.desc("id")).limit(limit)

    def recent_retrieves(self, limit: int = 10) -> DataFrame:
        return self.table("retrieves").orderBy(F.desc("ts"), F.desc("id")).limit(limit)

    def projects(self) -> DataFrame:
        """project, nodes, head_sha of every project that is known here."""
        n, _, order = self.graph
        return n.groupBy("project").agg(F.count("*").alias("nodes")).join(graph.heads(order).select("project", "head_sha"), "project", "left")

    def node_counts(self) -> DataFrame:
        return self.graph[0].groupBy("project", "label").agg(F.count("*").alias("n_all"), F.count_if(F.col("invalid_sha").isNull()).alias("n_live"))

    def report(self) -> DataFrame:
        """The whole summary of metrics."""
        return metrics.report(self.table("retrieves"), self.table("cache_stats"), self.table("ingest_stats"))

    def find_claims(self, query: str, now: float, limit: int = 5) -> DataFrame:
        return memory.rank_lexical(query, self.claims(limit=None), now, limit)

    def snapshot_list(self) -> DataFrame:
        return self.graph[2]

    def snapshot_gc(self, keep_last: int) -> DataFrame:
        return ingest.snapshots_kept(self.table("snapshot_manifest"), keep_last)

    def summary(self) -> DataFrame:
        return metrics.summary(self.table("retrieves"))

    def health(self) -> DataFrame:
        return metrics.latest_status(self.table("backend_health"))
