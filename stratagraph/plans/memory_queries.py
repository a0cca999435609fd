"""Claims, episodes, retrieval, metrics, ingest and sync over the test tables, with the SQL that checks them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.text import cosine, letters, normal_prompt
from stratagraph.operators import ingest, memory, metrics, pack, retrieval
from stratagraph.operators.snapshots import snapshot_order
from stratagraph.runtime import bounded_broadcast, cut
from stratagraph.sources.tables import canonical_json, table

#: The moment queries about recency take for now, the time claims are asked for, and the text that is searched for.
NOW, WHEN, QUERY = 1_735_000_000.0, 1_715_000_000.0, "what does MirrorMerger use in datavine"
#: The age limit of cached embeddings, and the similarity from which entities and claims count as the same in the tests.
CUTOFF, TAU = 1_712_000_000.0, 0.35


def _events(spark: SparkSession, d: str) -> DataFrame:
    # Parquet timestamps without zone are read as such; sessions are pinned to UTC.
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Claims


def _history(spark: SparkSession, d: str) -> DataFrame:
    return memory.claim_history(memory.valid_claims(table(spark, d, "claims")))


_CLAIM = ["subject", "predicate", "obj", "polarity", "id", "valid_at", "valid_to", "confidence", "evidence_span", "recorded_at", "head_sha", "session_id", "entity_subject_id"]


def q_claims_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select(*_CLAIM)


def q_claims_current(spark: SparkSession, d: str) -> DataFrame:
    return memory.current(_history(spark, d)).select(*_CLAIM)


def q_claims_as_of(spark: SparkSession, d: str) -> DataFrame:
    return memory.as_of(_history(spark, d), WHEN).select(*_CLAIM)


def q_claims_multi(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).where(~F.col("predicate").isin(*memory.SINGLE_VALUED)).select(*_CLAIM)


def q_claims_rank_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The five open claims nearest to the query's words."""
    return memory.rank_lexical(QUERY, memory.current(_history(spark, d)), NOW, 5).select("subject", "predicate", "obj", "polarity", "overlap", "score")


def q_claims_rank_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The five best of given hits: here every open claim, its similarity read off its confidence."""
    open_ = memory.current(_history(spark, d))
    hits = open_.select("id", F.round(1 - F.col("confidence") / 2, 6).alias("similarity")).distinct()
    return memory.rank_semantic(hits, open_, NOW, 5).select("id", "subject", "predicate", "obj", "score")


def q_claim_neardup(spark: SparkSession, d: str) -> DataFrame:
    """For each new vector (ids divisible by 20) the nearest of all, if near enough to count as the same."""
    v = _vectors(spark, d)
    return retrieval.top_k(v, v.where("id % 20 = 0"), 1, min_score=TAU).select("query", "id", "score")


def q_entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    pairs = retrieval.top_k(v, v, 1 << 20, min_score=0.85).select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity")).where("a < b")
    return memory.leaders(pairs, v.select("id"))


def q_claim_intent(spark: SparkSession, d: str) -> DataFrame:
    return memory.claim_intent(table(spark, d, "documents")).select("doc_id", "kind", "predicate")


# Episodes


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    verdict = F.when(F.col("doc_id") % 10 < 3, "idle").when(F.col("doc_id") % 2 == 0, "pass").otherwise("fail")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("double").alias("ts"), F.col("text").alias("prompt"), F.when(F.col("doc_id") % 2 == 1, F.col("kind")).alias("plan"), verdict.alias("verdict"), F.array_compact(F.array("lang", "source")).alias("tags"), "head_sha")


def q_episode_dedup(spark: SparkSession, d: str) -> DataFrame:
    return memory.episodes_dedup(_episodes(spark, d)).select("content_hash", "id", "ts", "plan", "verdict", "head_sha", F.array_join("tags", "|").alias("tags"), "n")


def q_episode_compact(spark: SparkSession, d: str) -> DataFrame:
    return memory.episodes_compact(_episodes(spark, d))


def q_recent_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most recent episodes."""
    return _episodes(spark, d).orderBy(F.desc("ts"), F.desc("id")).limit(20).select("id", "ts", "verdict")


def q_episode_filter(spark: SparkSession, d: str) -> DataFrame:
    """The five episodes to show of all, ranked by their ids."""
    hits = _episodes(spark, d).where("prompt is not null").select(F.col("id").alias("rank"), "id", "prompt", "verdict")
    return memory.episodes_shown(hits, QUERY, 5).select("id", normal_prompt(F.col("prompt")).alias("prompt"))


# Vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def q_vec_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.top_k(v, v.where("id % 20 = 0"), 10)


def q_vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.top_k(v.where("label = 3"), v.where("id % 20 = 0"), 10)


def q_vec_rerank(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    hits = retrieval.top_k(v, v.where("id % 20 = 0"), 20).join(v.select("id", "label"), "id")
    return retrieval.rerank(hits, F.col("label") == 3, F.col("label") == 7, 10).select("query", "id", "score", "rank")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Current vectors of one model, numbered by the order of their hashes' first digits; dense ones of length 64 only."""
    c = ingest.cache_put(table(spark, d, "embed_cache").where("model = 'mini-64'"))
    fine = (F.size("dense") == 64) & ~F.exists("dense", lambda x: x.isNull() | F.isnan(x)) & F.exists("dense", lambda x: x != 0)
    number = F.conv(F.substring("chunk_hash", 1, 15), 16, 10).cast("long")
    return cut(c.where(F.coalesce(fine, F.lit(False))).select(number.alias("id"), F.col("dense").alias("vector"), "sparse_idx", "sparse_val"))


def _branches(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    c = _cache(spark, d)
    q = c.where("id % 20 = 0")
    return retrieval.top_k(c, q, k), retrieval.sparse_top_k(c, q, k)


def q_sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    c = _cache(spark, d)
    return retrieval.sparse_top_k(c, c.where("id % 20 = 0"), 10)


def q_hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse_rrf(list(_branches(spark, d, 40)), 10)


def q_hybrid_dbsf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse_dbsf(list(_branches(spark, d, 40)), 10)


def _all_models(spark: SparkSession, d: str) -> DataFrame:
    """Current rows of all models, each model a collection; vector is null where the dense one isn't usable."""
    c = ingest.cache_put(table(spark, d, "embed_cache"))
    fine = (F.size("dense") == 64) & ~F.exists("dense", lambda x: x.isNull() | F.isnan(x)) & F.exists("dense", lambda x: x != 0)
    number = F.conv(F.substring("chunk_hash", 1, 15), 16, 10).cast("long")
    return cut(c.select("model", number.alias("id"), F.when(fine, F.col("dense")).alias("vector"), "sparse_idx", "sparse_val"))


def _branches_models(spark: SparkSession, d: str, k: int) -> list[DataFrame]:
    c = _all_models(spark, d)
    q = c.where("id % 20 = 0")
    return [retrieval.top_k(c, q, k, within=("model",)), retrieval.sparse_top_k(c, q, k, ("model",))]


def q_sparse_topk_models(spark: SparkSession, d: str) -> DataFrame:
    """q_sparse_topk over the whole table, within each model."""
    c = _all_models(spark, d)
    return retrieval.sparse_top_k(c, c.where("id % 20 = 0"), 10, ("model",))


def q_hybrid_rrf_models(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse_rrf(_branches_models(spark, d, 40), 10, ("model",))


def q_hybrid_dbsf_models(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse_dbsf(_branches_models(spark, d, 40), 10, ("model",))


def q_ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How often a vector's nearest have its own label."""
    v = _vectors(spark, d)
    q = v.where("id % 20 = 0")
    hits = retrieval.top_k(v, q, 10).join(v.select("id", "label"), "id").join(q.select(F.col("id").alias("query"), F.col("label").alias("gold")), "query")
    return retrieval.ir_measures(hits, q, F.col("label") == F.col("gold"))


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each chunk."""
    c = table(spark, d, "chunks")
    cols = ["project", "file_path", "kind", "sym_name", "lang", "start_line", "end_line", "text"]
    return c.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(*cols), F.struct("indexed_at", "text")).alias("r")).select("chunk_id", "r.*")


def q_keyword_baseline(spark: SparkSession, d: str) -> DataFrame:
    docs = _chunk_rows(spark, d).where("text is not null").select(F.concat_ws("/", "project", "file_path").alias("path"), "text")
    return retrieval.keyword_search(docs, table(spark, d, "retrieves").where("query_text is not null").select(F.col("query_text").alias("query")), 10)


def q_retrieve_pack(spark: SparkSession, d: str) -> DataFrame:
    """Code, episodes and claims for one query, as one table: section, rank, id, score. The query's vector is the first embedding's."""
    v = _vectors(spark, d)
    hits = retrieval.top_k(v, v.where("id = 0"), 16).join(bounded_broadcast(v.select("id", "label")), "id")
    code = retrieval.rerank(hits, F.col("label") == 3, F.col("label") == 7, 8).select(F.lit("code").alias("section"), "rank", F.col("id").cast("string").alias("id"), "score")
    shown = q_episode_filter(spark, d)
    eps = shown.select(F.lit("episodes").alias("section"), F.expr("row_number() over (order by id)").alias("rank"), F.col("id").cast("string").alias("id"), F.lit(0.0).alias("score"))
    top = q_claims_rank_lexical(spark, d)
    claims = top.select(F.lit("claims").alias("section"), F.expr("row_number() over (order by score desc, subject, predicate, obj, polarity)").alias("rank"), F.concat_ws(" ", "subject", "predicate", "obj").alias("id"), "score")
    return code.unionByName(eps).unionByName(claims)


#: Questions that are asked of the whole memory, and the similarity from which claims count as the same.
QUESTIONS, SAME = (QUERY, "where is the ledger cursor flushed when the batch is late", "warum verwirft der Dienst die Zeilen"), 0.995


def _open_claims(spark: SparkSession, d: str) -> DataFrame:
    """Open claims, each id once."""
    return memory.current(_history(spark, d)).groupBy("id").agg(F.min(F.struct("subject", "predicate", "obj", "polarity", "confidence", "evidence_span", "valid_at", "recorded_at", "head_sha")).alias("r")).select("id", "r.*")


def q_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Code, episodes and claims for three questions, all embedded by their letters: real paths, texts and flags."""
    c = _chunk_rows(spark, d).where("text is not null")
    code = c.select(F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "kind", F.col("sym_name").alias("name"), "text", ingest.looks_generated(F.col("file_path"), F.col("text")).alias("generated"))
    eps = _episodes(spark, d).where("prompt is not null").select(F.col("id").cast("string").alias("id"), "prompt", "plan", F.lit(None).cast("string").alias("patch"), "verdict")
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "query string")
    return pack.retrieve(asked, code, eps, _open_claims(spark, d), NOW, letters).select("query", "section", "rank", "id", "score")


def q_claims_lexical_all(spark: SparkSession, d: str) -> DataFrame:
    """The claims that three questions find by shared words, where claims have no vectors."""
    return memory.rank_lexical_all(spark.createDataFrame([(q,) for q in QUESTIONS], "query string"), _open_claims(spark, d), NOW, 5)


def q_claim_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Claims recorded last that say what an older open claim says in other words, by their letters."""
    o = cut(pack.embedded(_open_claims(spark, d), memory.claim_text(*[F.col(x) for x in ("subject", "predicate", "obj", "polarity", "evidence_span")]), letters))
    late = F.col("recorded_at") >= WHEN
    return pack.near_claims(o.where(late), o.where(~late), SAME)


# Metrics


def q_metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole summary: retrievals, the cache's hits and misses (of the current chunks' texts), and builds (of the manifests)."""
    split = q_embed_cache_split(spark, d).select(F.col("hit").cast("int").alias("hits"), (~F.col("hit")).cast("int").alias("misses"))
    builds = table(spark, d, "snapshot_manifest").where("counts is not null").select(F.get_json_object("counts", "$.nodes").cast("long").alias("symbols"), F.col("created_at").alias("ts"))
    return metrics.report(table(spark, d, "retrieves"), split, builds)


def q_metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(table(spark, d, "retrieves"))


def q_backend_latest(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest_status(table(spark, d, "backend_health"))


def q_tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tool_usage(_events(spark, d).select((F.col("user_id") % 3).alias("project"), F.col("event_type").alias("tool"), F.floor(F.col("value") * 10).alias("chars")))


def q_efficiency(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("session"), "event_type", F.floor(F.abs("value") * 10).alias("chars"))
    return metrics.efficiency(e.where("event_type in ('click', 'view')"), e.where("event_type = 'purchase'"))


def q_latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "backend_health").where("backend is not null").select(F.lower(F.trim("backend")).alias("backend"), "status", "latency_ms")
    return metrics.latency_quantiles(h, ["backend", "status"], "latency_ms")


def q_debounce(spark: SparkSession, d: str) -> DataFrame:
    return metrics.debounce(_events(spark, d), "user_id", "6 hours")


def q_breaker(spark: SparkSession, d: str) -> DataFrame:
    return metrics.breaker(_events(spark, d), "user_id", F.col("event_type") == "error", 2)


def q_breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """What a breaker would have let each event meet: it opens at the second error in a row, for six hours."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return metrics.breaker_states(e.withColumn("ts", F.col("us") / 1e6), "user_id", F.col("event_type") == "error", 2, 21_600.0).select("event_id", "state")


def q_ingest_status(spark: SparkSession, d: str) -> DataFrame:
    """How far each project's snapshot before the last lies behind its head, and how many files have changed since."""
    order = snapshot_order(table(spark, d, "snapshot_manifest"), table(spark, d, "graph_nodes"))
    last = order.where("next_sha is not null").groupBy("project").agg(F.max_by("head_sha", "idx").alias("sha"))
    return ingest.pending(order, last, q_delta(spark, d))


def q_turn_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return metrics.turn_gate(_events(spark, d), "user_id", t == "signup", t == "view", t == "click")


def q_session_episode(spark: SparkSession, d: str) -> DataFrame:
    return metrics.session_episodes(_events(spark, d), "user_id", F.col("event_type") == "signup", "props")


# Ingest and sync


def q_generated(spark: SparkSession, d: str) -> DataFrame:
    c = _chunk_rows(spark, d).where("kind = 'file'")
    return c.select("project", "file_path", ingest.looks_generated(F.col("file_path"), F.col("text")).alias("generated"))


def q_minified(spark: SparkSession, d: str) -> DataFrame:
    c = _chunk_rows(spark, d).where("kind = 'file'")
    return c.select("project", "file_path", ingest.looks_minified(F.col("text")).alias("minified"))


def q_sanity(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sanity(_chunk_rows(spark, d))


def q_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks built anew from the current symbols' texts: ids and lengths."""
    s = _chunk_rows(spark, d).where("kind <> 'file' and text is not null").select(F.col("file_path").alias("path"), F.col("sym_name").alias("name"), "kind", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("text").alias("snippet"))
    return ingest.symbol_chunks(s).select("chunk_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("h"))


def q_extract(spark: SparkSession, d: str) -> DataFrame:
    """Names of the symbols read from the current chunks' sources, with how many imports and calls each text has."""
    body = F.regexp_replace("text", "^FILE [^\n]*\n", "")
    files = _chunk_rows(spark, d).where("kind = 'file' and text is not null").select(F.concat_ws("/", "project", "file_path").alias("path"), body.alias("text"))
    return ingest.extract_files(files).select("path", F.explode_outer("symbols.name").alias("name"), F.size("imports").alias("n_imports"), F.size("calls").alias("n_calls"))


def _file_versions(spark: SparkSession, d: str) -> DataFrame:
    """The File nodes of the last two snapshots of each project: project, path, h, back (0 for the last)."""
    nodes = table(spark, d, "graph_nodes")
    order = snapshot_order(table(spark, d, "snapshot_manifest"), nodes)
    last = order.groupBy("project").agg(F.max("idx").alias("m"))
    two = order.join(last, "project").select("project", "head_sha", (F.col("m") - F.col("idx")).alias("back")).where("back < 2")
    files = nodes.where("label = 'File' and node_key is not null").join(bounded_broadcast(two), ["project", "head_sha"])
    return files.groupBy("project", F.col("node_key").alias("path"), "back").agg(F.max_by(canonical_json(F.col("props")), "loaded_at").alias("h"))


def q_delta(spark: SparkSession, d: str) -> DataFrame:
    v = _file_versions(spark, d)
    return ingest.delta(v.where("back = 1"), v.where("back = 0"), ["project", "path"], "h")


def q_reingest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files to read again: the changed ones in order of path, then those marked as generated."""
    v = cut(_file_versions(spark, d))
    full = F.concat_ws("/", "project", "path").alias("path")
    changed = ingest.delta(v.where("back = 1"), v.where("back = 0"), ["project", "path"], "h").where("kind = 'changed'").select(full, full.alias("position"))
    dirty = v.where("back = 0 and h like '%\"generated\":true%'").select(full, full.alias("position"))
    return ingest.reingest_paths(changed, dirty)


def q_health_check(spark: SparkSession, d: str) -> DataFrame:
    """Per project, files and symbols of the last snapshot against the files of the first."""
    nodes = table(spark, d, "graph_nodes")
    order = snapshot_order(table(spark, d, "snapshot_manifest"), nodes)
    n = nodes.join(bounded_broadcast(order.select("project", "head_sha", "idx", "next_sha")), ["project", "head_sha"]).select("project", "idx", "next_sha", "label", "node_key").distinct()
    per = n.groupBy("project").agg(*[F.count_if(c).alias(a) for a, c in (("prior_files", (F.col("idx") == 1) & (F.col("label") == "File")), ("files", F.col("next_sha").isNull() & (F.col("label") == "File")), ("symbols", F.col("next_sha").isNull() & (F.col("label") == "Symbol")))])
    return ingest.health_check(per)


_STATES = [(g, lk, p, "h1", dt, s, a, b) for g, lk, p, dt, s, a, b in product((True, False), (True, False), ("h1", "h0", None), (True, False), (True, False), ("a1", None), (True, False))]
_STATE_COLUMNS = ["is_git", "locked", "prior", "head", "dirty", "snapshot_at_head", "ancestor", "base_reachable"]


def q_sync_action(spark: SparkSession, d: str) -> DataFrame:
    """What to do in each of all states a sync can find."""
    return ingest.sync_action(spark.createDataFrame(_STATES, "is_git boolean, locked boolean, prior string, head string, dirty boolean, snapshot_at_head boolean, ancestor string, base_reachable boolean"))


def q_snapshot_gc(spark: SparkSession, d: str) -> DataFrame:
    return ingest.snapshots_kept(table(spark, d, "snapshot_manifest"), 2)


def q_ancestor_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """For every manifest the last snapshot with rows that isn't later."""
    m = table(spark, d, "snapshot_manifest").where("created_at is not null").groupBy("project", "head_sha").agg(F.min("created_at").alias("at"))
    have = snapshot_order(table(spark, d, "snapshot_manifest"), table(spark, d, "graph_nodes")).select("project", "head_sha", F.col("created_at").alias("at"))
    return ingest.ancestor_snapshot(m, have)


def q_snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").where("label is not null and node_key is not null").select("project", "head_sha", F.concat_ws("|", "label", "node_key").alias("line")).distinct()
    return ingest.digest(n, ["project", "head_sha"], F.col("line"))


def q_embed_cache_split(spark: SparkSession, d: str) -> DataFrame:
    batch = _chunk_rows(spark, d).where("text is not null").select("chunk_id", F.sha2("text", 256).alias("chunk_hash"))
    return ingest.cache_split(batch, table(spark, d, "embed_cache"), "mini-64")


def q_cache_vacuum(spark: SparkSession, d: str) -> DataFrame:
    return ingest.cache_vacuum(table(spark, d, "embed_cache"), CUTOFF).select("chunk_hash", "model", "ts")


def q_chunk_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each usable chunk vector with itself one version earlier, by expressions alone."""
    c = table(spark, d, "chunks").where("size(vector) = 64").select("chunk_id", "indexed_at", "vector").distinct()
    pair = c.alias("a").join(c.alias("b"), "chunk_id").where("a.indexed_at < b.indexed_at")
    return pair.select("chunk_id", F.round(cosine(F.col("a.vector"), F.col("b.vector")), 5).alias("score"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_H = """
WITH b AS (SELECT * REPLACE (regexp_replace(subject, '^\\s+|\\s+$', '', 'g') AS subject, regexp_replace(predicate, '^\\s+|\\s+$', '', 'g') AS predicate, regexp_replace(obj, '^\\s+|\\s+$', '', 'g') AS obj, coalesce(regexp_replace(evidence_span, '^\\s+|\\s+$', '', 'g'), '') AS evidence_span) FROM claims),
c AS (SELECT id, subject, replace(lower(predicate), ' ', '-') AS predicate, obj, polarity, confidence, evidence_span, valid_at, recorded_at, head_sha, session_id, entity_subject_id
  FROM b WHERE subject <> '' AND predicate <> '' AND obj <> '' AND polarity IS NOT NULL AND confidence BETWEEN 0 AND 1),
k AS (SELECT *, predicate IN ('prefers', 'uses', 'deployed-to', 'is-located-at', 'is-a', 'owns', 'assigned-to', 'depends-on') AS single, row_number() OVER (ORDER BY recorded_at, id) AS seq FROM c),
g AS (SELECT *, CASE WHEN single AND ((obj, polarity) IS DISTINCT FROM (lag(obj) OVER w, lag(polarity) OVER w)) THEN 1 ELSE 0 END AS chg FROM k WINDOW w AS (PARTITION BY subject, predicate ORDER BY recorded_at, id)),
i AS (SELECT *, CASE WHEN single THEN sum(chg) OVER (PARTITION BY subject, predicate ORDER BY recorded_at, id) ELSE 0 END AS island FROM g),
a AS (SELECT subject, predicate, obj, polarity, island, single, arg_min(id, seq) AS id, (array_agg(valid_at ORDER BY seq))[1] AS valid_at, max(confidence) AS confidence,
    coalesce(arg_max(evidence_span, seq) FILTER (evidence_span <> ''), '') AS evidence_span, max(recorded_at) AS recorded_at, arg_max(head_sha, seq) FILTER (head_sha IS NOT NULL) AS head_sha,
    arg_min(session_id, seq) FILTER (session_id IS NOT NULL) AS session_id, arg_min(entity_subject_id, seq) FILTER (entity_subject_id IS NOT NULL) AS entity_subject_id FROM i GROUP BY ALL),
h AS (SELECT *, CASE WHEN single THEN lead(valid_at) OVER (PARTITION BY subject, predicate ORDER BY island) END AS valid_to FROM a)
"""
_COLS = ", ".join(_CLAIM)
_TOK = r"regexp_extract_all(lower({}), '[a-z][a-z0-9_-]+')"
_DECAY = f"(0.5 + 0.5 * exp(-greatest(0.0, {NOW} - valid_at) / {memory.RECENCY}.0))"
_LEX = f"""
SELECT subject, predicate, obj, polarity, CAST(overlap AS INT) AS overlap, round(overlap * confidence * {_DECAY}, 6) AS score
  FROM (SELECT *, len(list_intersect(list_distinct({_TOK.format("concat_ws(' ', subject, obj, evidence_span)")}), list_distinct({_TOK.format(f"'{QUERY}'")}))) AS overlap FROM h WHERE valid_to IS NULL)
  WHERE overlap > 0 ORDER BY score DESC NULLS LAST, subject, predicate, obj, polarity LIMIT 5"""
_EP = """
WITH e AS (SELECT doc_id AS id, CAST(doc_id AS DOUBLE) AS ts, text AS prompt, CASE WHEN doc_id % 2 = 1 THEN kind END AS plan, CASE WHEN doc_id % 10 < 3 THEN 'idle' WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS verdict,
    list_filter([lang, source], lambda x: x IS NOT NULL) AS tags, head_sha, sha256(regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS h FROM documents)
"""
_NORM = r"substr(regexp_replace(lower(regexp_replace({}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), '[\s\x0B]+', ' ', 'g'), 1, 160)"
_SHOWN = f"""
SELECT id, p AS prompt FROM (SELECT id, {_NORM.format("prompt")} AS p, verdict, row_number() OVER (PARTITION BY {_NORM.format("prompt")} ORDER BY id) AS k FROM e WHERE prompt IS NOT NULL AND verdict <> 'idle')
  WHERE k = 1 AND p <> '{QUERY.lower()}' ORDER BY id LIMIT 5"""
_V = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
s AS (SELECT q.id AS query, v.id, v.label, q.label AS gold, round(list_cosine_similarity(q.x, v.x), 6) + 0.0 AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0)
"""


def _top(source: str, k: int, extra: str = "") -> str:
    return f"SELECT query, id, score, rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM {source}) WHERE rank <= {k}"


_C = """
WITH z AS (SELECT chunk_hash, dense, sparse_idx, sparse_val FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY ts DESC) AS k FROM embed_cache WHERE model = 'mini-64') WHERE k = 1),
c AS (SELECT CAST(('0x' || substr(chunk_hash, 1, 15)) AS BIGINT) AS id, CAST(dense AS DOUBLE[]) AS x, sparse_idx, sparse_val FROM z
  WHERE len(dense) = 64 AND len(list_filter(dense, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(dense, lambda y: y <> 0)) > 0),
t AS (SELECT id, unnest(sparse_idx) AS term, CAST(unnest(sparse_val) AS DOUBLE) AS weight FROM c),
tt AS (SELECT * FROM t WHERE weight > 0 AND NOT isnan(weight)),
f AS (SELECT term, ln(1 + ((SELECT count(*) FROM c) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tt GROUP BY term),
sp AS (SELECT q.id AS query, d.id, round(sum(q.weight * f.idf * d.weight), 6) AS score FROM tt q JOIN f ON q.term = f.term JOIN tt d ON d.term = q.term AND d.id <> q.id WHERE q.id % 20 = 0 GROUP BY ALL),
de AS (SELECT q.id AS query, d.id, round(list_cosine_similarity(q.x, d.x), 6) AS score FROM c q JOIN c d ON q.id <> d.id WHERE q.id % 20 = 0),
""" + "b1 AS (" + _top("de", 40) + "), b2 AS (" + _top("sp", 40) + ")"  # fmt: skip
_CM = """
WITH z AS (SELECT model, CAST(('0x' || substr(chunk_hash, 1, 15)) AS BIGINT) AS id, dense, sparse_idx, sparse_val FROM (SELECT *, row_number() OVER (PARTITION BY model, chunk_hash ORDER BY ts DESC) AS k FROM embed_cache WHERE model IS NOT NULL AND chunk_hash IS NOT NULL) WHERE k = 1),
c AS (SELECT model, id, CAST(dense AS DOUBLE[]) AS x FROM z WHERE len(dense) = 64 AND len(list_filter(dense, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(dense, lambda y: y <> 0)) > 0),
tt AS (SELECT * FROM (SELECT model, id, unnest(sparse_idx) AS term, CAST(unnest(sparse_val) AS DOUBLE) AS weight FROM z) WHERE weight > 0 AND NOT isnan(weight)),
n AS (SELECT model, count(*) AS total FROM z GROUP BY model),
f AS (SELECT model, term, ln(1 + (any_value(total) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tt JOIN n USING (model) GROUP BY model, term),
sp AS (SELECT q.model, q.id AS query, d.id, round(sum(q.weight * f.idf * d.weight), 6) AS score FROM tt q JOIN f ON q.model = f.model AND q.term = f.term JOIN tt d ON d.model = q.model AND d.term = q.term AND d.id <> q.id WHERE q.id % 20 = 0 GROUP BY ALL),
de AS (SELECT q.model, q.id AS query, d.id, round(list_cosine_similarity(q.x, d.x), 6) AS score FROM c q JOIN c d ON q.model = d.model AND q.id <> d.id WHERE q.id % 20 = 0),
"""
_TOP_M = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, query ORDER BY score DESC, id) AS rank FROM {}) WHERE rank <= {}"
_CM += "b1 AS (" + _TOP_M.format("de", 40) + "), b2 AS (" + _TOP_M.format("sp", 40) + ")"
_ONCE = "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, text DESC) AS k FROM chunks WHERE chunk_id IS NOT NULL) WHERE k = 1)"
_WORDS = "list_distinct(list_filter(" + _TOK + ", lambda t: len(t) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + "], t)))"
_ORDER = """
WITH m AS (SELECT project, head_sha, min(created_at) AS t FROM snapshot_manifest WHERE created_at IS NOT NULL GROUP BY ALL),
o AS (SELECT m.project, m.head_sha, t, row_number() OVER (PARTITION BY m.project ORDER BY t, m.head_sha) AS idx, max(t) OVER (PARTITION BY m.project) AS tm, count(*) OVER (PARTITION BY m.project) AS n FROM m SEMI JOIN graph_nodes g ON m.project = g.project AND m.head_sha = g.head_sha)
"""
_DELTA = _ORDER + """,
v AS (SELECT g.project, node_key AS path, n - idx AS back, list_sort([k || '=' || CAST(json_extract(p, '$."' || k || '"') AS VARCHAR) FOR k IN json_keys(p)]) AS h, json_extract_string(p, '$.generated') AS gen
  FROM (SELECT project, head_sha, node_key, arg_max(props, loaded_at) AS p FROM graph_nodes WHERE label = 'File' GROUP BY ALL) g JOIN o USING (project, head_sha) WHERE n - idx < 2),
d AS (SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'deleted' ELSE 'changed' END AS kind
  FROM (SELECT * FROM v WHERE back = 0) a FULL JOIN (SELECT * FROM v WHERE back = 1) b ON a.project = b.project AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h)
"""


def _letters(x: str) -> str:
    return "CAST([" + ", ".join(f"len({x}) - len(replace({x}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "] AS DOUBLE[])"


_GENERATED = "coalesce(len(list_intersect(string_split(lower(file_path), '/'), ['generated', '__generated__', 'openapi-gen', 'swagger-gen'])) > 0 OR regexp_matches(lower(file_path), '(\\.generated\\.ts|\\.generated\\.js|\\.g\\.ts|\\.g\\.dart)$') OR " + " OR ".join(f"contains(lower(substr(text, 1, 2048)), '{m}')" for m in ingest.GENERATED_MARKERS) + ", false)"
_ENTRY = "(regexp_extract(lower(file_path), '[^/]*$') IN (" + ", ".join(f"'{e}'" for e in retrieval.ENTRYPOINTS) + ") OR " + " OR ".join(f"ends_with(lower(file_path), '{e}')" for e in retrieval.ENTRYPOINT_SUFFIXES) + ")"
_OPEN = """
oc AS (SELECT id, r.* FROM (SELECT id, min(struct_pack(subject, predicate, obj, polarity, confidence, evidence_span, valid_at, recorded_at)) AS r FROM h WHERE valid_to IS NULL GROUP BY id)),
ox AS (SELECT *, lower(subject || CASE WHEN polarity THEN ' ' ELSE ' not ' END || predicate || ' ' || obj || CASE WHEN evidence_span <> '' THEN chr(10) || chr(10) || evidence_span ELSE '' END) AS low FROM oc)
"""
_QS = "qs AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]) AS query)"


def _ranked(source: str, k: int, by: str = "score DESC, id", part: str = "query") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {by}) AS rank FROM {source}) WHERE rank <= {k}"


def _sql_value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


_INTENT = " ".join(f"WHEN regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {i}" for i, (_, _, p) in enumerate(memory.INTENTS))

SQL = {
    "q_claims_history": _H + f"SELECT {_COLS} FROM h",
    "q_claims_current": _H + f"SELECT {_COLS} FROM h WHERE valid_to IS NULL",
    "q_claims_as_of": _H + f"SELECT {_COLS} FROM h WHERE valid_at <= {WHEN} AND (valid_to IS NULL OR valid_to > {WHEN})",
    "q_claims_multi": _H + f"SELECT {_COLS} FROM h WHERE NOT single",
    "q_claims_rank_lexical": _H + _LEX,
    "q_claims_rank_semantic": _H + f"""SELECT id, subject, predicate, obj, score FROM (SELECT h.id, h.subject, h.predicate, h.obj, round(s.similarity * confidence * {_DECAY}, 6) AS score
        FROM h JOIN (SELECT DISTINCT id, round(1 - confidence / 2, 6) AS similarity FROM h WHERE valid_to IS NULL) s USING (id) WHERE valid_to IS NULL) ORDER BY score DESC NULLS LAST, id LIMIT 5""",
    "q_claim_neardup": _V + f"SELECT query, id, score FROM ({_top('s', 1)}) WHERE score >= {TAU}",
    "q_claim_intent": "WITH x AS (SELECT doc_id, text, trim(text) AS t FROM documents WHERE text <> ''), y AS (SELECT doc_id, CASE " + _INTENT + " END AS i FROM x WHERE NOT (t LIKE '%?' AND NOT regexp_matches(substr(t, 1, len(t) - 1), '[.!]'))) SELECT doc_id, ["
        + ", ".join(f"'{k}'" for k, _, _ in memory.INTENTS) + "][i + 1] AS kind, [" + ", ".join(f"'{p}'" for _, p, _ in memory.INTENTS) + "][i + 1] AS predicate FROM y WHERE i IS NOT NULL",
    "q_episode_dedup": _EP + """, u AS (SELECT h, tag, min(struct_pack(id := id, p := pos)) AS spot FROM (SELECT h, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM e WHERE prompt IS NOT NULL) GROUP BY ALL)
        SELECT e.h AS content_hash, min(id) AS id, max(ts) AS ts, coalesce(arg_min(plan, id) FILTER (plan <> ''), (array_agg(plan ORDER BY id))[1]) AS plan, arg_min(verdict, id) AS verdict, arg_min(head_sha, id) FILTER (head_sha <> '') AS head_sha,
          coalesce((SELECT string_agg(tag, '|' ORDER BY spot) FROM u WHERE u.h = e.h), '') AS tags, count(*) AS n FROM e WHERE prompt IS NOT NULL GROUP BY e.h""",
    "q_episode_compact": _EP + "SELECT kept, id AS removed, ts FROM (SELECT id, min(id) OVER (PARTITION BY h) AS kept, max(ts) OVER (PARTITION BY h) AS ts FROM e WHERE prompt IS NOT NULL) WHERE id <> kept",
    "q_recent_episodes": _EP + "SELECT id, ts, verdict FROM e ORDER BY ts DESC LIMIT 20",
    "q_episode_filter": _EP + _SHOWN,
    "q_vec_topk": _V + _top("s", 10),
    "q_vec_topk_filtered": _V + _top("(SELECT * FROM s WHERE label = 3)", 10),
    "q_vec_rerank": _V + ", w AS (" + _top("s", 20, ", label") + ") SELECT query, id, score, rank FROM (SELECT query, id, score2 AS score, row_number() OVER (PARTITION BY query ORDER BY score2 DESC, rank) AS rank FROM (SELECT *, round(score - CASE WHEN label = 3 THEN 0.15 ELSE 0 END + CASE WHEN label = 7 THEN 0.05 ELSE 0 END, 6) AS score2 FROM w)) WHERE rank <= 10",
    "q_sparse_topk": _C + _top("sp", 10),
    "q_hybrid_rrf": _C + ", r AS (SELECT query, id, round(sum(1.0 / (rank + 60)), 9) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY ALL) " + _top("r", 10),
    "q_hybrid_dbsf": _C + """, n AS (SELECT query, id, CASE WHEN sd > 1e-12 THEN (score - (av - 3 * sd)) / (6 * sd) ELSE 0.5 END AS part FROM (SELECT *, stddev_samp(score) OVER (PARTITION BY query) AS sd, avg(score) OVER (PARTITION BY query) AS av FROM b1)
        UNION ALL SELECT query, id, CASE WHEN sd > 1e-12 THEN (score - (av - 3 * sd)) / (6 * sd) ELSE 0.5 END FROM (SELECT *, stddev_samp(score) OVER (PARTITION BY query) AS sd, avg(score) OVER (PARTITION BY query) AS av FROM b2)),
        r AS (SELECT query, id, round(sum(part), 6) AS score FROM n GROUP BY ALL) """ + _top("r", 10),
    "q_sparse_topk_models": _CM + _TOP_M.format("sp", 10),
    "q_hybrid_rrf_models": _CM + ", r AS (SELECT model, query, id, round(sum(1.0 / (rank + 60)), 9) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY ALL) " + _TOP_M.format("r", 10),
    "q_hybrid_dbsf_models": _CM + """, p AS (SELECT *, 1 AS b FROM b1 UNION ALL SELECT *, 2 FROM b2), w AS (SELECT *, stddev_samp(score) OVER v AS sd, avg(score) OVER v AS av FROM p WINDOW v AS (PARTITION BY b, model, query)),
        r AS (SELECT model, query, id, round(sum(CASE WHEN sd > 1e-12 THEN (score - (av - 3 * sd)) / (6 * sd) ELSE 0.5 END), 6) AS score FROM w GROUP BY ALL) """ + _TOP_M.format("r", 10),
    "q_ir_metrics": _V + ", w AS (" + _top("s", 10, ", label, gold") + """), f AS (SELECT v.id, min(rank) FILTER (w.label = w.gold) AS first FROM v LEFT JOIN w ON w.query = v.id WHERE v.id % 20 = 0 GROUP BY v.id)
        SELECT count(*) AS n, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 10 THEN 1 / log2(first + 1) ELSE 0 END), 6) AS ndcg_10 FROM f""",
    "q_keyword_baseline": _ONCE + f""", dw AS (SELECT DISTINCT concat_ws('/', project, file_path) AS path, unnest({_WORDS.format("text")}) AS word FROM c WHERE text IS NOT NULL),
        fw AS (SELECT path, word FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY path) AS k FROM dw) WHERE k <= 500), qw AS (SELECT query, unnest({_WORDS.format("query")}) AS word FROM (SELECT DISTINCT query_text AS query FROM retrieves WHERE query_text IS NOT NULL)),
        mt AS (SELECT query, path, count(*) AS matched FROM qw JOIN fw USING (word) GROUP BY ALL) SELECT query, path, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY matched DESC, path) AS rank FROM mt) WHERE rank <= 10""",
    "q_metrics_summary": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM retrieves) WHERE k = 1)
        SELECT count(*) AS n, round(coalesce(avg(total_ms) FILTER (total_ms >= 0 AND NOT isnan(total_ms) AND NOT isinf(total_ms)), 0), 1) AS avg_total_ms, round(coalesce(avg(embed_ms) FILTER (embed_ms >= 0 AND NOT isnan(embed_ms) AND NOT isinf(embed_ms)), 0), 1) AS avg_embed_ms,
          round(coalesce(avg(code_search_ms) FILTER (code_search_ms >= 0 AND NOT isnan(code_search_ms) AND NOT isinf(code_search_ms)), 0), 1) AS avg_code_ms, CAST(sum(code_hit_count) AS BIGINT) AS code_hits, CAST(sum(eps_hit_count) AS BIGINT) AS eps_hits, CAST(sum(claims_hit_count) AS BIGINT) AS claims_hits, max(ts) AS last_ts FROM r""",
    "q_backend_latest": "SELECT backend, status, ts FROM (SELECT lower(trim(backend)) AS backend, status, ts, row_number() OVER (PARTITION BY lower(trim(backend)) ORDER BY ts DESC, id DESC) AS k FROM backend_health WHERE backend IS NOT NULL AND ts IS NOT NULL) WHERE k = 1",
    "q_tool_usage": "WITH t AS (SELECT user_id % 3 AS project, event_type AS tool, CAST(floor(value * 10) AS BIGINT) AS chars FROM events) SELECT project, tool, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars, round(avg(chars), 3) AS avg_chars FROM t GROUP BY ROLLUP (project, tool)",
    "q_efficiency": """WITH e AS (SELECT user_id AS session, event_type, CAST(floor(abs(value) * 10) AS BIGINT) AS chars FROM events), t AS (SELECT session, sum(chars) AS a FROM e WHERE event_type IN ('click', 'view') GROUP BY 1), r AS (SELECT session, sum(chars) AS b FROM e WHERE event_type = 'purchase' GROUP BY 1)
        SELECT session, CAST(coalesce(a, 0) AS BIGINT) AS tool_chars, CAST(coalesce(b, 0) AS BIGINT) AS read_chars, round(CASE WHEN coalesce(a, 0) + coalesce(b, 0) = 0 THEN 0 ELSE coalesce(a, 0) / (coalesce(a, 0) + coalesce(b, 0)) END, 6) AS share FROM t FULL JOIN r USING (session)""",
    "q_latency_quantiles": """WITH v AS (SELECT lower(trim(backend)) AS backend, status, list_sort(list(latency_ms)) AS x, count(*) AS n FROM backend_health WHERE backend IS NOT NULL AND latency_ms >= 0 AND NOT isnan(latency_ms) AND NOT isinf(latency_ms) GROUP BY ALL),
        w AS (SELECT *, CAST(floor(0.95 * (n + 1)) AS BIGINT) AS j, 0.95 * (n + 1) - floor(0.95 * (n + 1)) AS part FROM v)
        SELECT backend, status, n, round((x[(n + 1) // 2] + x[n // 2 + 1]) / 2, 6) AS p50, round(CASE WHEN n < 20 THEN x[n] ELSE x[j] * (1 - part) + x[j + 1] * part END, 6) AS p95 FROM w""",
    "q_debounce": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS started, max(t) + 21600000000 AS fired, count(*) AS n FROM s GROUP BY user_id, k""",
    "q_breaker": """WITH r AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
        SELECT user_id, event_id AS opened FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nth FROM r WHERE f) WHERE nth = 2""",
    "q_turn_gate": """WITH t AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
        f AS (SELECT user_id, turn, min(ts) FILTER (event_type = 'click') AS g, min(ts) FILTER (event_type = 'view') AS m, arg_min(event_id, ts) FILTER (event_type = 'click') AS event_id FROM t GROUP BY ALL)
        SELECT user_id, CAST(turn AS BIGINT) AS turn, event_id FROM f WHERE g IS NOT NULL AND (m IS NULL OR g < m)""",
    "q_session_episode": "SELECT user_id, arg_min(props, ts) AS text, 'idle' AS verdict FROM events WHERE event_type = 'signup' GROUP BY user_id",
    "q_generated": _ONCE + " SELECT project, file_path, coalesce(len(list_intersect(string_split(lower(file_path), '/'), ['generated', '__generated__', 'openapi-gen', 'swagger-gen'])) > 0 OR regexp_matches(lower(file_path), '(\\.generated\\.ts|\\.generated\\.js|\\.g\\.ts|\\.g\\.dart)$') OR "
        + " OR ".join(f"contains(lower(substr(text, 1, 2048)), '{m}')" for m in ingest.GENERATED_MARKERS) + ", false) AS generated FROM c WHERE kind = 'file'",
    "q_minified": _ONCE + """, s AS (SELECT project, file_path, substr(text, 1, 4096) AS t FROM c WHERE kind = 'file'), l AS (SELECT *, string_split(regexp_replace(t, '\\n$', ''), chr(10)) AS x FROM s)
        SELECT project, file_path, coalesce(len(t) > 0 AND (NOT contains(t, chr(10)) OR list_max(list_transform(x, lambda y: len(y))) > 2000 OR len(t) / len(x) > 200), false) AS minified FROM l""",
    "q_sanity": _ONCE + """, s AS (SELECT project, NOT contains(' ' || regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g') || ' ', ' ' || sym_name || ' ') AS missing FROM c WHERE kind <> 'file' AND regexp_matches(sym_name, '^[A-Za-z_][A-Za-z0-9_]*$') AND text IS NOT NULL)
        SELECT project, count(*) AS n, count(*) FILTER (missing) AS missing, round(count(*) FILTER (missing) / count(*), 6) AS share, round(count(*) FILTER (missing) / count(*), 6) > 0.02 AS suspect FROM s GROUP BY project""",
    "q_chunk_ids": _ONCE + r""", s AS (SELECT file_path AS path, sym_name AS name, kind, start_line, text AS snippet, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3] AS l FROM c WHERE kind <> 'file' AND text IS NOT NULL),
        b AS (SELECT substr(sha1(path || chr(0) || concat_ws('#', name, start_line)), 1, 32) AS chunk_id, concat_ws(chr(10), 'FILE ' || path, 'KIND ' || kind || ' NAME ' || name, CASE WHEN len(l) > 0 THEN 'SIGNATURE' || chr(10) || array_to_string(l, chr(10)) END, substr(snippet, 1, 1500)) AS t FROM s)
        SELECT chunk_id, CAST(len(t) AS INT) AS n_chars, sha256(t) AS h FROM b""",
    "q_delta": _DELTA + "SELECT project, path, kind FROM d",
    "q_reingest_paths": _DELTA + """, x AS (SELECT project || '/' || path AS path, 0 AS l FROM d WHERE kind = 'changed' UNION ALL SELECT project || '/' || path, 1 FROM v WHERE back = 0 AND gen = 'true')
        SELECT path, row_number() OVER (ORDER BY l, path) AS position FROM (SELECT path, min(l) AS l FROM x GROUP BY path)""",
    "q_health_check": _ORDER + """, n AS (SELECT DISTINCT g.project, idx, o.n, label, node_key FROM graph_nodes g JOIN o USING (project, head_sha)),
        p AS (SELECT project, count(*) FILTER (idx = 1 AND label = 'File') AS prior_files, count(*) FILTER (idx = n AND label = 'File') AS files, count(*) FILTER (idx = n AND label = 'Symbol') AS symbols FROM n GROUP BY project)
        SELECT *, files > 1.2 * prior_files AND symbols < 0.5 * files AND symbols > 0 AS rebuild FROM p""",
    "q_sync_action": "SELECT *, CASE WHEN NOT is_git THEN 'full_ingest' WHEN locked THEN 'noop' WHEN prior = head AND NOT dirty THEN 'noop' WHEN prior = head THEN 'dirty_only' WHEN snapshot_at_head THEN 'pull_snapshot' WHEN prior IS NOT NULL AND base_reachable THEN 'incremental' WHEN ancestor IS NOT NULL THEN 'pull_then_incremental' ELSE 'full_ingest' END AS action FROM (VALUES "
        + ", ".join("(" + ", ".join(map(_sql_value, s)) + ")" for s in _STATES) + ") t(" + ", ".join(_STATE_COLUMNS) + ")",
    "q_snapshot_gc": "SELECT project, head_sha, t AS created_at, row_number() OVER (PARTITION BY project ORDER BY t DESC, head_sha DESC) <= 2 AS keep FROM (SELECT project, head_sha, min(created_at) AS t FROM snapshot_manifest WHERE created_at IS NOT NULL GROUP BY ALL)",
    "q_ancestor_snapshot": _ORDER + "SELECT m.project, m.head_sha, arg_max(o.head_sha, struct_pack(t := o.t, s := o.head_sha)) AS ancestor FROM m LEFT JOIN o ON m.project = o.project AND o.t <= m.t GROUP BY ALL",
    "q_snapshot_digest": """WITH l AS (SELECT DISTINCT project, head_sha, sha256(label || '|' || node_key) AS h FROM graph_nodes WHERE label IS NOT NULL AND node_key IS NOT NULL),
        b AS (SELECT project, head_sha, substr(h, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM l GROUP BY ALL), c AS (SELECT project, head_sha, substr(b, 1, 3) AS b, sha256(string_agg(b || h, '' ORDER BY b || h)) AS h FROM b GROUP BY project, head_sha, substr(b, 1, 3))
        SELECT project, head_sha, sha256(string_agg(b || h, '' ORDER BY b || h)) AS digest FROM c GROUP BY ALL""",
    "q_embed_cache_split": _ONCE + " SELECT chunk_id, sha256(text) AS chunk_hash, EXISTS (SELECT 1 FROM embed_cache e WHERE e.chunk_hash = sha256(c.text) AND model = 'mini-64' AND dense IS NOT NULL) AS hit FROM c WHERE text IS NOT NULL",
    "q_chunk_similarity": "WITH c AS (SELECT DISTINCT chunk_id, indexed_at, CAST(vector AS DOUBLE[]) AS v FROM chunks WHERE len(vector) = 64) SELECT a.chunk_id, round(CASE WHEN list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) <> 0 THEN list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END, 5) AS score FROM c a JOIN c b ON a.chunk_id = b.chunk_id AND a.indexed_at < b.indexed_at",
    "q_cache_vacuum": f"SELECT chunk_hash, model, max(ts) AS ts FROM embed_cache WHERE chunk_hash IS NOT NULL AND model IS NOT NULL GROUP BY ALL HAVING max(ts) >= {CUTOFF}",
}
SQL["q_retrieve_pack"] = (
    "WITH p1 AS (" + _V.replace("WHERE q.id % 20 = 0", "WHERE q.id = 0") + ", w AS (" + _top("s", 16, ", label") + ") SELECT 'code' AS section, rank, CAST(id AS VARCHAR) AS id, score FROM (SELECT id, score2 AS score, row_number() OVER (ORDER BY score2 DESC, rank) AS rank FROM (SELECT *, round(score - CASE WHEN label = 3 THEN 0.15 ELSE 0 END + CASE WHEN label = 7 THEN 0.05 ELSE 0 END, 6) AS score2 FROM w)) WHERE rank <= 8), "
    "p2 AS (SELECT 'episodes' AS section, row_number() OVER (ORDER BY id) AS rank, CAST(id AS VARCHAR) AS id, 0.0 AS score FROM (" + _EP + _SHOWN + ")), "
    "p3 AS (SELECT 'claims' AS section, row_number() OVER (ORDER BY score DESC NULLS LAST, subject, predicate, obj, polarity) AS rank, concat_ws(' ', subject, predicate, obj) AS id, score FROM (" + _H + _LEX + ")) SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3"
)
SQL["q_retrieve"] = (
    _H.rstrip() + ", " + _OPEN + ", " + _QS + f""", qv AS (SELECT query, {_letters("lower(query)")} AS x FROM qs),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, text DESC) AS k FROM chunks WHERE chunk_id IS NOT NULL) WHERE k = 1 AND text IS NOT NULL),
cv AS (SELECT chunk_id AS id, {_GENERATED} AS gen, {_ENTRY} AS entry, {_letters("lower(text)")} AS x FROM ch),
cs AS (SELECT query, id, gen, entry, round(list_cosine_similarity(qv.x, cv.x), 6) AS score FROM qv, cv WHERE list_sum(cv.x) > 0),
c1 AS ({_ranked("cs", 16)}),
c2 AS (SELECT query, id, rank AS old, round(score - CASE WHEN gen THEN 0.15 ELSE 0 END + CASE WHEN entry THEN 0.05 ELSE 0 END, 6) AS score FROM c1),
c3 AS ({_ranked("c2", 8, "score DESC, old")}),
ep AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS prompt, CASE WHEN doc_id % 10 < 3 THEN 'idle' WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN doc_id % 2 = 1 THEN kind END AS plan FROM documents WHERE text IS NOT NULL),
el AS (SELECT *, lower('PROMPT:' || chr(10) || prompt || CASE WHEN plan <> '' THEN chr(10) || chr(10) || 'PLAN:' || chr(10) || plan ELSE '' END || chr(10) || chr(10) || 'VERDICT: ' || verdict) AS low FROM ep),
ev AS (SELECT id, verdict, {_NORM.format("prompt")} AS norm, {_letters("low")} AS x FROM el),
es AS (SELECT query, id, norm, verdict, round(list_cosine_similarity(qv.x, ev.x), 6) AS score FROM qv, ev),
e1 AS ({_ranked("es", 15)}),
e2 AS (SELECT query, id, score, rank AS old FROM e1 WHERE verdict <> 'idle' AND norm <> {_NORM.format("query")} QUALIFY row_number() OVER (PARTITION BY query, norm ORDER BY rank) = 1),
e3 AS ({_ranked("e2", 5, "old")}),
ov AS (SELECT id, confidence, valid_at, {_letters("low")} AS x FROM ox),
os AS (SELECT query, id, confidence, valid_at, round(list_cosine_similarity(qv.x, ov.x), 6) AS sim, sim AS score FROM qv, ov),
o1 AS ({_ranked("os", 15)}),
o2 AS (SELECT query, id, round(sim * confidence * {_DECAY}, 6) AS score FROM o1),
o3 AS ({_ranked("o2", 5)})
SELECT query, 'code' AS section, rank, id, score FROM c3 UNION ALL SELECT query, 'episodes', rank, id, score FROM e3 UNION ALL SELECT query, 'claims', rank, id, score FROM o3"""
)
SQL["q_claims_lexical_all"] = _H.rstrip() + ", " + _OPEN + ", " + _QS + f""",
m AS (SELECT query, id, confidence, valid_at, len(list_intersect(list_distinct({_TOK.format("concat_ws(' ', subject, obj, evidence_span)")}), list_distinct({_TOK.format("query")}))) AS overlap FROM oc, qs),
s AS (SELECT query, id, round(overlap * confidence * {_DECAY}, 6) AS score FROM m WHERE overlap > 0)
SELECT query, id, score, rank FROM ({_ranked("s", 5)})"""
SQL["q_claim_collapse"] = _H.rstrip() + ", " + _OPEN + f""", v AS (SELECT *, {_letters("low")} AS x FROM ox),
p AS (SELECT a.id AS query, b.id, round(list_cosine_similarity(a.x, b.x), 6) AS score, a.subject = b.subject AND a.predicate = b.predicate AND a.obj = b.obj AS same FROM v a JOIN v b ON a.polarity = b.polarity WHERE a.recorded_at >= {WHEN} AND b.recorded_at < {WHEN})
SELECT query AS id, id AS near_id, score FROM ({_ranked("p", 1)}) WHERE score >= {SAME} AND NOT same"""
SQL["q_metrics_report"] = """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM retrieves) WHERE k = 1),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, text DESC) AS k FROM chunks WHERE chunk_id IS NOT NULL) WHERE k = 1 AND text IS NOT NULL),
    x AS (SELECT EXISTS (SELECT 1 FROM embed_cache e WHERE e.chunk_hash = sha256(c.text) AND model = 'mini-64' AND dense IS NOT NULL) AS hit FROM c)
    SELECT (SELECT count(*) FROM r) AS retrieves, (SELECT round(coalesce(avg(total_ms) FILTER (total_ms >= 0 AND NOT isnan(total_ms) AND NOT isinf(total_ms)), 0), 1) FROM r) AS avg_total_ms,
      (SELECT CAST(count(*) FILTER (hit) AS BIGINT) FROM x) AS cache_hits, (SELECT CAST(count(*) FILTER (NOT hit) AS BIGINT) FROM x) AS cache_misses, (SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 3) FROM x) AS hit_ratio,
      (SELECT count(*) FROM snapshot_manifest WHERE counts IS NOT NULL) AS ingests, (SELECT CAST(coalesce(sum(CAST(json_extract_string(counts, '$.nodes') AS BIGINT)), 0) AS BIGINT) FROM snapshot_manifest WHERE counts IS NOT NULL) AS symbols,
      (SELECT max(created_at) FROM snapshot_manifest WHERE counts IS NOT NULL) AS last_ingest_ts"""
SQL["q_ingest_status"] = _DELTA + """, k AS (SELECT project, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'deleted') AS deleted FROM d GROUP BY project)
    SELECT p.project, p.head_sha, q.head_sha AS last_sha, CAST(p.n - coalesce(q.idx, 0) AS INT) AS behind, coalesce(changed, 0) AS changed, coalesce(deleted, 0) AS deleted
    FROM o p LEFT JOIN o q ON q.project = p.project AND q.idx = p.n - 1 LEFT JOIN k ON k.project = p.project WHERE p.idx = p.n"""
