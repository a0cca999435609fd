"""Queries of the problems tagged llm, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import handwritten, leakage, mixing, percentiles, similar, splitting, stuffing
from stratagraph.sources.tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = similar.current_vectors(table(spark, sf_dir, "chunks"), "chunk_id", F.lit("chunks"), "vector", "indexed_at", 64)
    cache = similar.current_vectors(table(spark, sf_dir, "embed_cache"), "chunk_hash", F.col("model"), "dense", "ts", 64)
    return chunks.unionByName(cache)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(similar.neighbours(_vectors(spark, sf_dir)))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against brute force per space, for every row whose id's hash is divisible by 20, against all rows."""
    vectors = _vectors(spark, sf_dir)
    exact = similar.brute_force(vectors, vectors.where(F.pmod(F.xxhash64("id"), F.lit(20)) == 0))
    got = similar.neighbours(vectors).select("space", "a", "b", F.lit(1).alias("hit"))
    both = exact.join(got, ["space", "a", "b"], "left")
    return both.groupBy("space").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_reasons(spark, sf_dir).select("project", "node_key")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found with the reason of each file."""
    return handwritten.not_handwritten(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "graph_nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.unavoidable_cuts(table(spark, sf_dir, "chunks"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized current texts."""
    return splitting.pieces(table(spark, sf_dir, "chunks"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.spam_pages(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.page_scores(table(spark, sf_dir, "documents"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.measures(table(spark, sf_dir, "retrieves"), table(spark, sf_dir, "backend_health"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per metric, backend and day: rank error 0."""
    return percentiles.percentile_rows(percentiles.daily(_measures(spark, sf_dir)), ["metric", "backend", "day"])


def p7_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of months and totals, combined from daily ladders, with the bound of their rank error."""
    return percentiles.with_months(percentiles.daily(_measures(spark, sf_dir), percentiles.RUNGS))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per metric and backend over all days, by the same multi-select."""
    rows = _measures(spark, sf_dir).select(F.concat_ws("\u0001", "metric", "backend").alias("g"), "x")
    part = F.split("g", "\u0001")
    selected = percentiles.multi_select(rows)
    return percentiles.percentile_rows(selected.select(part[0].alias("metric"), part[1].alias("backend"), *selected.columns), ["metric", "backend"])


_P7 = """
WITH r AS (SELECT ts, total_ms, embed_ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, total_ms DESC NULLS LAST, embed_ms DESC NULLS LAST) AS k FROM retrieves WHERE id IS NOT NULL AND ts IS NOT NULL) WHERE k = 1),
h AS (SELECT ts, backend, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, latency_ms DESC NULLS LAST, backend DESC NULLS LAST) AS k FROM backend_health WHERE id IS NOT NULL AND ts IS NOT NULL) WHERE k = 1),
a AS (
  SELECT 'total_ms' AS metric, '' AS backend, ts, total_ms AS x FROM r UNION ALL SELECT 'embed_ms', '', ts, embed_ms FROM r
  UNION ALL SELECT 'latency_ms', lower(trim(backend)), ts, latency_ms FROM h WHERE backend IS NOT NULL),
v AS (SELECT metric, backend, strftime(make_timestamp(CAST(floor(ts * 1000000) AS BIGINT)), '%Y-%m-%d') AS day, x FROM a WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AND x >= 0),
"""

_P7_DAY = _P7 + """
k AS (SELECT *, row_number() OVER (PARTITION BY metric, backend, day ORDER BY x) AS rank, count(*) OVER (PARTITION BY metric, backend, day) AS n FROM v),
p AS (SELECT unnest([50, 90, 95, 99]) AS q)
SELECT metric, backend, day, CAST(q AS DOUBLE) AS percent, x AS value, n FROM k, p WHERE rank = greatest(1, (n * q + 99) // 100)
"""

def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that takes part."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p7_percentiles": p7_percentiles, "p7_months": p7_months, "p7_totals": p7_totals, "p10_found": p10_found, "p10_scores": p10_scores, "p8_found": p8_found, "p8_passages": p8_passages, "p8_report": p8_report, "p5_found": p5_found, "p5_pieces": p5_pieces, "p1_found": p1_found, "p1_recall": p1_recall, "p2_found": p2_found, "p2_reasons": p2_reasons}

_P8 = """
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
f AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))
"""

SQL: dict[str, str] = {
    "p8_found": _P8 + "SELECT doc_id, item_id FROM f",
    "p8_report": _P8 + "SELECT item_id, suite, (SELECT count(DISTINCT doc_id) FROM f WHERE f.item_id = e.item_id) AS n_docs FROM (SELECT DISTINCT item_id, suite FROM eval_items) e",
    "p5_found": """
WITH c AS (SELECT chunk_id, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) AS k FROM chunks WHERE chunk_id IS NOT NULL) WHERE k = 1 AND length(text) > 1500),
l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM c),
p AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY chunk_id ORDER BY no) - length(line) - 1 AS spot, regexp_full_match(line, '[ \\t\\r]*') AS blank FROM l),
b AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY no) AS block FROM p),
k AS (SELECT chunk_id, block, min(no) AS line_no, min(spot) AS s, max(spot + length(line) - CASE WHEN ends_with(line, chr(13)) THEN 1 ELSE 0 END) AS e FROM b WHERE NOT blank GROUP BY ALL),
n AS (SELECT *, lag(s) OVER (PARTITION BY chunk_id ORDER BY s) AS ps, lag(e) OVER (PARTITION BY chunk_id ORDER BY s) AS pe FROM k)
SELECT chunk_id, line_no FROM n WHERE pe - ps <= 1380 AND e - s <= 1380 AND e - ps > 1500
""",
    "p7_percentiles": _P7_DAY,
    "p7_totals": _P7_DAY.replace("metric, backend, day", "metric, backend"),
}
