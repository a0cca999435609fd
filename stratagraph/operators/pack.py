"""One call from a question to what is known about it: code, episodes and claims in one table, set-wise over many questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions.text import normal_prompt
from stratagraph.operators import memory, retrieval
from stratagraph.runtime import cut

#: How many times the wished number of hits the code, episode and claim searches fetch before they are ranked again.
FETCH_CODE, FETCH_EPISODES, FETCH_CLAIMS = 2, 3, 3
#: Characters of a prompt in a rendered pack and in a machine-readable one.
SHOWN, TOLD = 120, 240

Embed = Callable[[Column], Column]


def episode_text(prompt: Column, plan: Column, patch: Column, verdict: Column) -> Column:
    """The text an episode is embedded by; its headings are fixed values, as are those of render()."""
    part = lambda head, x: F.when(x != "", F.concat(F.lit(head), x))
    return F.concat_ws("\n\n", F.concat(F.lit("PROMPT:\n"), prompt), part("PLAN:\n", plan), part("PATCH:\n", patch), part("VERDICT: ", verdict))


def embedded(rows: DataFrame, text: Column, embed: Embed | None) -> DataFrame:
    """rows with a vector: their own where they have one, else that of the text (missing ones are filled in, as a backfill does)."""
    own = F.col("vector") if "vector" in rows.columns else F.lit(None).cast("array<float>")
    return rows.withColumn("vector", own if embed is None else F.coalesce(own.cast("array<double>"), embed(text).cast("array<double>")))


def code_hits(queries: DataFrame, code: DataFrame, k: int, mode: str = "dense") -> DataFrame:
    """query, rank, id, score of the k best code chunks: dense, or fused with sparse terms ('rrf', 'dbsf'), then ranked again.

    queries: query, vector and, unless dense, sparse_idx, sparse_val; code: id, path, generated, vector and these. Generated
    files are lowered and entry points raised among FETCH_CODE * k candidates.
    """
    if mode not in ("dense", "rrf", "dbsf"):
        raise ValueError("mode must be dense, rrf or dbsf")
    asked = queries.withColumnRenamed("query", "id")
    fetch = FETCH_CODE * k
    hits = retrieval.top_k(code, asked, fetch if mode == "dense" else fetch * retrieval.PREFETCH)
    if mode != "dense":
        fuse = retrieval.fuse_rrf if mode == "rrf" else retrieval.fuse_dbsf
        hits = fuse([hits, retrieval.sparse_top_k(code, asked, fetch * retrieval.PREFETCH)], fetch)
    about = hits.join(code.select("id", "path", "generated"), "id")
    return retrieval.rerank(about, F.coalesce("generated", F.lit(False)), retrieval.is_entrypoint(F.col("path")), k).select("query", "rank", "id", "score")


def episode_hits(queries: DataFrame, episodes: DataFrame, k: int, include_idle: bool = False) -> DataFrame:
    """query, rank, id, score of the k nearest episodes worth showing: not idle, not the question itself, each prompt once."""
    hits = retrieval.top_k(episodes, queries.withColumnRenamed("query", "id"), FETCH_EPISODES * k)
    rows = hits.join(episodes.select("id", normal_prompt(F.col("prompt")).alias("norm"), "verdict"), "id").where(F.col("norm") != normal_prompt(F.col("query")))
    rows = rows if include_idle else rows.where("verdict is null or verdict <> 'idle'")
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("query", "norm").orderBy("rank"))).where("rn = 1")
    again = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    return first.withColumn("rank", again).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def claim_hits(queries: DataFrame, open_claims: DataFrame, k: int, now: float, semantic: bool = True) -> DataFrame:
    """query, rank, id, score of the k best open claims: by similarity, confidence and age, or, without vectors, by shared words.

    open_claims: id, subject, predicate, obj, confidence, evidence_span, valid_at and, if semantic, vector.
    """
    if semantic:
        hits = retrieval.top_k(open_claims, queries.withColumnRenamed("query", "id"), FETCH_CLAIMS * k)
        scored = hits.join(open_claims.select("id", "confidence", "valid_at"), "id").withColumn("score", F.round(F.col("score") * F.col("confidence") * memory.recency(now, F.col("valid_at")), 6))
        return retrieval.ranked(scored.drop("rank"), k).select("query", "rank", "id", "score")
    return memory.rank_lexical_all(queries.select("query"), open_claims, now, k).select("query", "rank", "id", "score")


def retrieve(queries: DataFrame, code: DataFrame, episodes: DataFrame, open_claims: DataFrame | None, now: float, embed: Embed, *, k_code: int = 8, k_episodes: int = 5, k_claims: int = 5, include_idle: bool = False, mode: str = "dense", semantic_claims: bool = True) -> DataFrame:
    """query, section ('code', 'episodes', 'claims'), rank, id, score, about (map of what is shown of a hit), for each question.

    queries: query STRING (repeated ones count once, null ones not). code: id, path, start, end, kind, name, text, generated;
    episodes: id, prompt, plan, patch, verdict; open_claims: as memory.current() has them, or None where no claims are kept.
    Ids are strings; each table may have vectors of its own in `vector`, what has none is embedded. Without semantic_claims
    claims are found by shared words, as when no embedder is at hand for them. Empty tables have empty sections.
    """
    asked = queries.where("query is not null").dropDuplicates(["query"])
    asked = cut(embedded(asked, F.col("query"), embed))
    show = lambda **c: F.create_map(*[x for name, col in c.items() for x in (F.lit(name), col.cast("string"))])

    def section(name: str, hits: DataFrame, rows: DataFrame, about: Column) -> DataFrame:
        return hits.join(rows.select("id", about.alias("about")), "id").select("query", F.lit(name).alias("section"), F.col("rank").cast("long").alias("rank"), "id", "score", "about")

    c = cut(embedded(code, F.col("text"), embed).drop("text"))
    out = section("code", code_hits(asked, c, k_code, mode), c, show(**{x: F.col(x) for x in ("path", "start", "end", "kind", "name")}))
    e = cut(embedded(episodes, episode_text(*[F.col(x) for x in ("prompt", "plan", "patch", "verdict")]), embed))
    out = out.unionByName(section("episodes", episode_hits(asked, e, k_episodes, include_idle), e, show(verdict=F.col("verdict"), prompt=F.substring("prompt", 1, TOLD))))
    if open_claims is not None and k_claims > 0:
        text = memory.claim_text(*[F.col(x) for x in ("subject", "predicate", "obj", "polarity", "evidence_span")])
        o = cut(embedded(open_claims, text, embed if semantic_claims else None))
        out = out.unionByName(section("claims", claim_hits(asked, o, k_claims, now, semantic_claims), o, show(**{x: F.col(x) for x in ("subject", "predicate", "obj", "polarity", "confidence", "valid_at", "head_sha")})))
    return out


def pack_json(pack: DataFrame) -> DataFrame:
    """query, json: each question's pack as one object with its sections, in order of rank; a section without hits is empty."""
    hit = F.struct("rank", F.map_concat("about", F.create_map(F.lit("id"), F.col("id"), F.lit("score"), F.col("score").cast("string"))).alias("about"))
    part = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == name, F.struct(F.col("rank"), F.to_json(hit["about"]).alias("j"))))), lambda x: x["j"])
    lists = [F.concat(F.lit(f'"{name}":['), F.array_join(part(name), ","), F.lit("]")) for name in ("code", "episodes", "claims")]
    query = F.regexp_extract(F.to_json(F.struct("query")), r"^\{(.*)\}$", 1)
    return pack.groupBy("query").agg(F.concat_ws(",", *lists).alias("body")).select("query", F.concat(F.lit("{"), query, F.lit(","), F.col("body"), F.lit("}")).alias("json"))


def render(pack: DataFrame) -> DataFrame:
    """query, text: each question's pack for reading, a heading for each section with hits and a line for each hit."""
    a = lambda k: F.coalesce(F.col("about")[k], F.lit("None"))
    line = (
        F.when(F.col("section") == "code", F.concat(F.lit("- "), a("path"), F.lit(":"), a("start"), F.lit("-"), a("end"), F.lit(" ["), a("kind"), F.lit(" "), a("name"), F.lit("] score="), F.format_string("%.3f", "score")))
        .when(F.col("section") == "episodes", F.concat(F.lit("- "), F.col("id"), F.lit(" verdict="), a("verdict"), F.lit(" :: "), F.substring(a("prompt"), 1, SHOWN)))
        .otherwise(F.concat(F.lit("- "), a("subject"), F.lit(" "), a("predicate"), F.lit(" "), a("obj"), F.when(F.col("about")["polarity"] == "false", " (NEGATED)").otherwise(""), F.format_string(" (conf=%.2f)", F.col("about")["confidence"].cast("double"))))
    )
    part = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == name, F.struct("rank", line.alias("line"))))), lambda x: x["line"])
    heads = (("code", "## Code"), ("episodes", "## Episodes"), ("claims", "## User claims"))
    texts = pack.groupBy("query").agg(*[part(n).alias(n) for n, _ in heads])
    bodies = [F.when(F.size(n) > 0, F.concat(F.lit(h + "\n"), F.array_join(n, "\n"))) for n, h in heads]
    return texts.select("query", F.concat_ws("\n\n", F.concat(F.lit("# Query\n"), "query"), *bodies).alias("text"))


def near_claims(new: DataFrame, open_claims: DataFrame, threshold: float) -> DataFrame:
    """id, near_id, score: new claims that say what an open one of the same polarity says in other words.

    Both: id, subject, predicate, obj, polarity, vector. Only the nearest counts, from the threshold up; with the very same
    triple it is no near duplicate, as claim_history() refreshes it anyhow. A threshold of 1 or more finds none.
    """
    if threshold >= 1:
        return new.limit(0).selectExpr("id", "id as near_id", "cast(null as double) as score")
    hits = retrieval.top_k(open_claims.select("id", "polarity", "vector"), new.select("id", "polarity", "vector"), 1, threshold, ("polarity",))
    triple = lambda df, key, s: df.select(F.col("id").alias(key), F.struct("subject", "predicate", "obj").alias(s))
    both = hits.select(F.col("query").alias("id"), F.col("id").alias("near_id"), "score").join(triple(new, "id", "a"), "id").join(triple(open_claims, "near_id", "b"), "near_id")
    return both.where("a <> b").select("id", "near_id", "score")


def collapse_near(new: DataFrame, open_claims: DataFrame, near: DataFrame) -> DataFrame:
    """New claims as they are to be stored: one that is near to an open claim takes its triple, so that it only refreshes that one."""
    to = near.select("id", "near_id").join(open_claims.select(F.col("id").alias("near_id"), F.struct("subject", "predicate", "obj").alias("to")), "near_id").drop("near_id")
    return new.join(to, "id", "left").select(*[F.coalesce(F.col("to")[c], F.col(c)).alias(c) if c in ("subject", "predicate", "obj") else F.col(c) for c in new.columns])
