"""Claims with two times, and episodes: upserts expressed over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions.text import content_hash, kebab, normal_prompt, strip, tokens

#: Predicates of which a subject has one value at a time (fixed values).
SINGLE_VALUED = ("prefers", "uses", "deployed-to", "is-located-at", "is-a", "owns", "assigned-to", "depends-on")
#: Time after which the weight of a claim's recency has fallen to 1/e of it, in seconds.
RECENCY = 30 * 86_400


def valid_claims(claims: DataFrame) -> DataFrame:
    """Claims with non-empty subject, predicate and object, a polarity and a confidence within 0..1.

    Subjects, objects and evidence lose outer white space, and keep their case; predicates are in kebab case; null or blank
    evidence is ''.
    """
    s, p, o, e = (strip(F.col(c)) for c in ("subject", "predicate", "obj", "evidence_span"))
    ok = claims.where((s != "") & (p != "") & (o != "") & F.col("polarity").isNotNull() & F.col("confidence").between(0, 1))
    return ok.withColumns({"predicate": kebab(F.col("predicate")), "subject": s, "obj": o, "evidence_span": F.coalesce(e, F.lit(""))})


def claim_history(claims: DataFrame) -> DataFrame:
    """All versions of all claims, as if each had been asserted in order of arrival (recorded_at, id).

    Of a single-valued predicate a different object or polarity closes the open claim at the new one's valid_at; the same
    again refreshes it: greatest confidence, last evidence that isn't empty, last recorded_at and head_sha, first session
    and entity, valid_at unchanged. Claims of other predicates coexist and are only refreshed.
    """
    single = F.col("predicate").isin(*SINGLE_VALUED)
    # A null head_sha or session must not win, an empty evidence neither: each is taken by the rows that have one.
    seq = F.struct("recorded_at", "id")
    arrival = W.partitionBy("subject", "predicate").orderBy("recorded_at", "id")
    state = F.struct("obj", "polarity")
    rows = claims.withColumn("changed", F.when(single & ~state.eqNullSafe(F.lag(state).over(arrival)), 1).otherwise(0))
    rows = rows.withColumn("island", F.when(single, F.sum("changed").over(arrival)).otherwise(0))
    merged = rows.groupBy("subject", "predicate", "obj", "polarity", "island").agg(
        F.min_by("id", seq).alias("id"), F.min_by("valid_at", seq).alias("valid_at"), F.max("confidence").alias("confidence"),
        F.coalesce(F.max_by("evidence_span", F.when(F.col("evidence_span") != "", seq)), F.lit("")).alias("evidence_span"),
        F.max("recorded_at").alias("recorded_at"), F.max_by("head_sha", F.when(F.col("head_sha").isNotNull(), seq)).alias("head_sha"),
        F.min_by("session_id", F.when(F.col("session_id").isNotNull(), seq)).alias("session_id"),
        F.min_by("entity_subject_id", F.when(F.col("entity_subject_id").isNotNull(), seq)).alias("entity_subject_id"),
    )
    # An island of 0 has no successor: only single-valued predicates number theirs.
    nxt = F.lead("valid_at").over(W.partitionBy("subject", "predicate").orderBy("island"))
    return merged.withColumn("valid_to", F.when(single, nxt)).drop("island")


def current(history: DataFrame) -> DataFrame:
    return history.where("valid_to is null")


def as_of(history: DataFrame, when: float) -> DataFrame:
    return history.where((F.col("valid_at") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def recency(now: float, valid_at: Column) -> Column:
    return 0.5 + 0.5 * F.exp(-F.greatest(F.lit(0.0), now - valid_at) / RECENCY)


def rank_lexical(query: str, open_claims: DataFrame, now: float, limit: int | None = None) -> DataFrame:
    """Claims that share words with the query, by overlap * confidence * recency; without words in the query by confidence.

    Adds overlap, score and rank; ties by subject, predicate, object, polarity.
    """
    asked = tokens(F.lit(query))
    bag = tokens(F.concat_ws(" ", "subject", "obj", "evidence_span"))
    overlap = F.size(F.array_intersect(bag, asked))
    none = F.size(asked) == 0
    score = F.when(none, F.col("confidence")).otherwise(overlap * F.col("confidence") * recency(now, F.col("valid_at")))
    scored = open_claims.withColumn("overlap", overlap).where(none | (F.col("overlap") > 0)).withColumn("score", F.round(score, 6))
    # The rank is taken over the limited rows: a partial top-k per task, then one small sort.
    top = scored.orderBy(F.desc("score"), F.when(none, -F.col("valid_at")), "subject", "predicate", "obj", "polarity")
    return top.limit(limit) if limit is not None else top


def rank_lexical_all(queries: DataFrame, open_claims: DataFrame, now: float, limit: int) -> DataFrame:
    """rank_lexical() for many questions (query): query, id, score, rank; only claims that share a word with it, ties by id.

    Questions and claims meet by their words; a common word's claims are spread over tasks.
    """
    from stratagraph.runtime import salted_join

    asked = queries.select("query", F.explode(tokens(F.col("query"))).alias("word"))
    held = open_claims.select("id", "confidence", "valid_at", F.explode(tokens(F.concat_ws(" ", "subject", "obj", "evidence_span"))).alias("word"))
    met = salted_join(held, asked, ["word"], ["id"]).groupBy("query", "id", "confidence", "valid_at").agg(F.count("*").alias("overlap"))
    scored = met.withColumn("score", F.round(F.col("overlap") * F.col("confidence") * recency(now, F.col("valid_at")), 6))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit).select("query", "id", "score", "rank")


def rank_semantic(hits: DataFrame, open_claims: DataFrame, now: float, limit: int) -> DataFrame:
    """Hits (id, similarity) of a vector search with their claims, by similarity * confidence * recency; unknown ids are dropped."""
    ranked = hits.join(open_claims, "id").withColumn("score", F.round(F.col("similarity") * F.col("confidence") * recency(now, F.col("valid_at")), 6))
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def claim_text(subject: Column, predicate: Column, obj: Column, polarity: Column, evidence: Column) -> Column:
    """The text a claim is embedded by."""
    head = F.concat_ws(" ", subject, F.when(~polarity, F.lit("not")), predicate, obj)
    return F.when(evidence != "", F.concat_ws("\n\n", head, evidence)).otherwise(head)


def episodes_dedup(episodes: DataFrame) -> DataFrame:
    """Episodes (id, ts, prompt, plan, verdict, tags, head_sha, and patch and meta if there) as adding them one by one in order of (ts, id) leaves them.

    The same trimmed prompt is one episode: its first id, the last arrival's ts, the first plan, verdict and head_sha that
    isn't null or empty (the first arrival's are kept as they are), and all tags in order of their first arrival. patch goes
    like plan; of meta, a map of strings, the last value of each key counts.
    """
    seq = F.struct("ts", "id")

    def first_full(c: str) -> Column:
        return F.coalesce(F.min_by(c, F.when(F.col(c) != "", seq)), F.min_by(c, seq)).alias(c)

    more = [first_full("patch")] if "patch" in episodes.columns else []
    if "meta" in episodes.columns:
        episodes = episodes.withColumn("_entries", F.coalesce(F.map_entries("meta"), F.array().cast("array<struct<key:string,value:string>>")))
        more.append(F.sort_array(F.collect_list(F.struct("ts", "id", "_entries"))).alias("_all"))
    tag_lists = F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "tags"))), lambda x: x["tags"])
    out = episodes.where("prompt is not null").groupBy(content_hash(F.col("prompt")).alias("content_hash")).agg(
        F.min_by("id", seq).alias("id"), F.max_by("ts", seq).alias("ts"), F.min_by("prompt", seq).alias("prompt"), first_full("plan"), first_full("verdict"), first_full("head_sha"),
        F.array_distinct(F.flatten(tag_lists)).alias("tags"), F.count("*").alias("n"), *more,
    )
    if "_all" not in out.columns:
        return out
    entries = F.flatten(F.col("_all._entries"))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return out.withColumn("meta", F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))).drop("_all")


def episodes_compact(episodes: DataFrame) -> DataFrame:
    """kept, removed, ts: for each prompt given more than once the oldest id, an id to remove, and the ts the kept one gets."""
    h = episodes.where("prompt is not null").withColumn("h", content_hash(F.col("prompt")))
    w = W.partitionBy("h")
    marked = h.withColumn("kept", F.min(F.struct("ts", "id")).over(w)["id"]).withColumn("last", F.max("ts").over(w))
    return marked.where("id <> kept").select("kept", F.col("id").alias("removed"), F.col("last").alias("ts"))


def episodes_shown(hits: DataFrame, query: str, limit: int = 5, include_idle: bool = False) -> DataFrame:
    """Of ranked hits (rank, id, prompt, verdict) those worth showing: not idle, not the query itself, each prompt once."""
    norm = normal_prompt(F.col("prompt"))
    rows = hits.withColumn("norm", norm).where(norm != normal_prompt(F.lit(query)))
    rows = rows if include_idle else rows.where("verdict is null or verdict <> 'idle'")
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("norm").orderBy("rank"))).where("rn = 1")
    return first.orderBy("rank").limit(limit).drop("norm", "rn")


def leaders(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, leader: greedy entity resolution in the order of ids, from pairs (a, b, similarity) within the threshold.

    Taken one by one, an item joins the most similar leader before it, or becomes a leader if no leader is near. Here all
    items whose earlier neighbours are decided are decided at once, round by round, with the same result.
    """
    from stratagraph.runtime import cut

    both = cut(pairs.select(F.least("a", "b").alias("earlier"), F.greatest("a", "b").alias("later"), "similarity"))
    open_ = cut(ids.select("id").distinct())
    leads, out = None, None
    while open_.limit(1).count():
        waiting = both.join(open_.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct()
        ready = open_.join(waiting, "id", "left_anti")
        near = both.join(leads.withColumnRenamed("id", "earlier"), "earlier", "left_semi") if leads is not None else both.limit(0)
        best = near.groupBy(F.col("later").alias("id")).agg(F.max_by("earlier", F.struct("similarity", -F.col("earlier"))).alias("leader"))
        now = cut(ready.join(best, "id", "left").select("id", F.coalesce("leader", "id").alias("leader")))
        out = now if out is None else out.unionByName(now)
        fresh = now.where("id = leader").select("id")
        leads = fresh if leads is None else leads.unionByName(fresh)
        open_ = cut(open_.join(now.select("id"), "id", "left_anti"))
    return out if out is not None else ids.select("id", F.col("id").alias("leader")).limit(0)


#: Ordered patterns of a message that asserts a claim: kind, predicate, pattern (fixed values).
INTENTS = (
    ("preference", "prefers", r"\b(i|we)\s+(love|like|prefer|enjoy|favor|favour)\b[^.!?\n]{1,120}"),
    ("preference", "wants-to", r"\b(i|we)\s+(want|need|wanna|wish|would\s+like)\s+to\b[^.!?\n]{1,120}"),
    ("rejection", "rejected", r"\b(i|we)\s+(hate|dislike|reject|refuse|don'?t\s+(want|like|use)|won'?t\s+(use|ship|build))\b[^.!?\n]{1,120}"),
    ("rejection", "rejected", r"\b(let'?s\s+not|we'?re\s+not\s+(using|doing|shipping|building))\b[^.!?\n]{1,120}"),
    ("decision", "uses", r"\b(we|our\s+(project|team|app|service))\s+(use|uses|using|deploy|deploys|deployed|run|runs|running)\b[^.!?\n]{1,120}"),
    ("ownership", "owns", r"\b([A-Z][a-zA-Z]+|i|we)\s+own[s]?\b[^.!?\n]{1,120}"),
    ("location", "is-located-at", r"\b(lives?|located|sits?|is)\s+(at|in|under)\s+[`\"']?[a-z0-9_\-./]+[`\"']?"),
)


def claim_intent(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds kind and predicate of the first pattern that a message matches; messages without one, and pure questions, are left out."""
    t = F.trim(F.col(text))
    question = t.endswith("?") & ~F.substring(t, 1, F.length(t) - 1).rlike(r"[.!]")
    first = None
    for kind, predicate, pattern in INTENTS:
        hit = F.col(text).rlike("(?i)" + pattern)
        value = F.struct(F.lit(kind).alias("kind"), F.lit(predicate).alias("predicate"))
        first = F.when(hit, value) if first is None else first.when(hit, value)
    return messages.where(F.col(text).isNotNull() & (F.col(text) != "") & ~question).withColumn("_i", first).where("_i is not null").withColumn("kind", F.col("_i.kind")).withColumn("predicate", F.col("_i.predicate")).drop("_i")
