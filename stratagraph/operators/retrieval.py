"""Exact vector search for sets of queries, sparse search, fusion, re-ranking and the measures of retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions.text import tokens
from stratagraph.runtime import BROADCAST_ROWS, cut

#: Constant of reciprocal rank fusion, and how many times k each branch fetches.
RRF_K, PREFETCH = 60, 4
#: Rows of a part of the vectors, and of a block of queries, that one task holds.
PART_ROWS = 20_000
#: Adjustments of a hit's score (fixed values).
GENERATED_PENALTY, ENTRYPOINT_BOOST = 0.15, 0.05
ENTRYPOINTS = ("app.config.ts", "app.routes.ts", "app-routing.module.ts", "main.ts", "main.server.ts", "app.module.ts", "app.component.ts", "index.ts", "providers.ts")
ENTRYPOINT_SUFFIXES = (".module.ts", ".routing.ts", ".routes.ts", ".config.ts")
#: Words that keyword search leaves out (fixed values).
STOP_WORDS = (
    "a an the and or of in on for to is are was were be been being do does did how where what which who when why from into via with without that this these those it its "
    "app code file files service services component components feature features module modules angular typescript ts function method class type interface"
).split()
#: Parts of the files of one word where the queries' words are too many to broadcast.
WORD_SALTS = 16
#: Parts of the rows and of the queries of one sparse term.
TERM_SALTS = 4


def top_k(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -2.0, within: tuple[str, ...] = ()) -> DataFrame:
    """query, id, score, rank: for each query its k nearest vectors by cosine (DOUBLE, rounded to 6; ties by id), itself left out.

    vectors and queries: id LONG or STRING, vector. Vectors are split into parts of about PART_ROWS rows and queries into blocks
    of as many; each pair of a part and a block is one task of matrix products, from which only k rows of a query come out.
    Vectors without length, null vectors and an empty side find nothing. within: columns of both sides and of the result;
    only rows that agree in them meet, and only these need vectors of one length.
    """
    parts, blocks = (max(1, -(-df.count() // PART_ROWS)) for df in (vectors, queries))

    def side(df: DataFrame, role: int, own: str, n: int, other: str, m: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        rows = df.where("vector is not null and id is not null").dropna(subset=list(within)).select(*within, "id", "vector", F.lit(role).cast("byte").alias("role"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own))
        return rows.withColumn(other, spread).select(*within, "id", "vector", "role", "part", "block")

    v = side(vectors, 0, "part", parts, "block", blocks)
    q = side(queries, 1, "block", blocks, "part", parts)

    def scan(table: pa.Table) -> pa.Table:
        # In order of id, so that the place of a row breaks ties.
        table = table.combine_chunks().sort_by([("id", "ascending"), ("role", "ascending")])
        role, ids = table.column("role").to_numpy(), table.column("id")
        same = np.cumsum(np.concatenate(([0], np.asarray(pc.not_equal(ids[1:], ids[:-1])).astype(np.int64)))) if len(ids) else np.array([], np.int64)
        column = table.column("vector").combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1)
        rows, asks = np.flatnonzero((role == 0) & (norm > 0)), np.flatnonzero((role == 1) & (norm > 0))
        a, b, c = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([])]
        for lo in range(0, len(asks) if len(rows) else 0, 256):
            some = asks[lo : lo + 256]
            s = np.round((x[some] @ x[rows].T) / np.outer(norm[some], norm[rows]), 6)
            s[same[some][:, None] == same[rows][None, :]] = -9
            least = np.partition(s, -k, axis=1)[:, -k][:, None] if k < s.shape[1] else -8
            i, j = np.nonzero(s >= np.maximum(least, min_score))
            found = s[i, j]
            order = np.lexsort((j, -found, i))
            i = i[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, order = i[place < k], order[place < k]
            a.append(some[i]), b.append(rows[j[order]]), c.append(found[order])
        hits = {"query": ids.take(pa.array(np.concatenate(a))), "id": ids.take(pa.array(np.concatenate(b))), "score": np.concatenate(c)}
        return pa.table({w: pa.repeat(table.column(w)[0], len(hits["id"])) for w in within} | hits)

    kinds = "".join(f"`{w}` {vectors.schema[w].dataType.simpleString()}, " for w in within)
    kind = vectors.schema["id"].dataType.simpleString()
    found = v.unionByName(q).groupBy(*within, "part", "block").applyInArrow(scan, kinds + f"query {kind}, id {kind}, score double")
    return ranked(found.withColumn("score", F.col("score") + F.lit(0.0)), k, within)


def ranked(hits: DataFrame, k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """The k best hits of each query with their rank; ties by id."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*within, "query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def is_entrypoint(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    hit = name.isin(*ENTRYPOINTS)
    for s in ENTRYPOINT_SUFFIXES:
        hit = hit | name.endswith(s)
    return F.coalesce(hit, F.lit(False))


def rerank(hits: DataFrame, generated: Column, entrypoint: Column, k: int) -> DataFrame:
    """Hits with their scores lowered for generated files and raised for entry points, ranked anew; ties keep their order."""
    adjusted = hits.withColumn("score", F.round(F.col("score") - F.when(generated, GENERATED_PENALTY).otherwise(0.0) + F.when(entrypoint, ENTRYPOINT_BOOST).otherwise(0.0), 6))
    w = W.partitionBy("query").orderBy(F.desc("score"), "rank")
    return adjusted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_terms(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """id, term, weight (and the columns within) of (id, sparse_idx, sparse_val); only positive weights that are numbers."""
    z = rows.select(*within, "id", F.explode(F.arrays_zip("sparse_idx", "sparse_val")).alias("z"))
    return z.select(*within, "id", F.col("z.sparse_idx").alias("term"), F.col("z.sparse_val").cast("double").alias("weight")).where("weight > 0 and not isnan(weight)")


def sparse_top_k(rows: DataFrame, queries: DataFrame, k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """query, id, score, rank by the sum of query weight * row weight * idf over shared terms; idf = ln(1 + (N - n + 0.5) / (n + 0.5)).

    within: columns of both sides and of the result; only rows that agree in them meet and count for the idf.
    """
    terms = sparse_terms(rows, within)
    n_rows = rows.groupBy(*within).agg(F.count("*").alias("total"))
    n_terms = terms.groupBy(*within, "term").agg(F.count("*").alias("n"))
    idf = (n_terms.join(n_rows, list(within)) if within else n_terms.crossJoin(F.broadcast(n_rows))).select(*within, "term", F.log(1 + (F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))
    asked = sparse_terms(queries, within).join(idf, [*within, "term"]).select(*within, F.col("id").alias("query"), "term", (F.col("weight") * F.col("idf")).alias("qw"))
    # A common term is in many rows and in many queries: both sides come in as many parts of each.
    both = lambda df, own, other: df.withColumn(own, F.pmod(F.xxhash64("query" if own == "_q" else "id"), F.lit(TERM_SALTS)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    met = both(asked, "_q", "_r").join(both(terms, "_r", "_q"), [*within, "term", "_q", "_r"]).where("query <> id")
    return ranked(met.groupBy(*within, "query", "id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score")), k, within)


def fuse_rrf(branches: list[DataFrame], k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked branches (query, id, rank)."""
    all_ = branches[0].select(*within, "query", "id", "rank")
    for b in branches[1:]:
        all_ = all_.unionByName(b.select(*within, "query", "id", "rank"))
    return ranked(all_.groupBy(*within, "query", "id").agg(F.round(F.sum(1 / (F.col("rank") + RRF_K)), 9).alias("score")), k, within)


def fuse_dbsf(branches: list[DataFrame], k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Distribution-based fusion: scores of a branch and query are scaled from mean - 3 sd .. mean + 3 sd to 0 .. 1, then added up."""
    w = W.partitionBy(*within, "query")

    def scaled(b: DataFrame) -> DataFrame:
        sd = F.stddev_samp("score").over(w)
        return b.select(*within, "query", "id", F.when(sd > 1e-12, (F.col("score") - (F.avg("score").over(w) - 3 * sd)) / (6 * sd)).otherwise(0.5).alias("part"))

    all_ = scaled(branches[0])
    for b in branches[1:]:
        all_ = all_.unionByName(scaled(b))
    return ranked(all_.groupBy(*within, "query", "id").agg(F.round(F.sum("part"), 6).alias("score")), k, within)


def keyword_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, path, matched, rank: files by how many of a query's words they hold; ties by path.

    docs: path, text; queries: query (the text). Words have at least three characters; every file that holds a word counts.
    Each batch of files gives its k best of each query, so that no pair of a query and a file is shuffled; where the
    queries' words are too many to hold at once, words are joined, the files of each in WORD_SALTS parts.
    """
    word = F.array_except(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 3), F.array(*map(F.lit, STOP_WORDS)))
    asked = cut(queries.select("query", F.col("query").alias("text")).distinct().select("query", F.explode(word).alias("word")))
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = asked.select("word").distinct()
    held = docs.select("path", F.explode(word).alias("word")).join(F.broadcast(words) if few else words, "word", "left_semi")
    if few:
        asks: dict[str, list[str]] = {}
        for r in asked.collect():
            asks.setdefault(r["query"], []).append(r["word"])

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n, paths = len(pdf), pdf.sort_values("path", na_position="first", ignore_index=True)
                at = pd.Series(np.repeat(np.arange(n), paths.words.map(len)))
                files = {w: x.to_numpy() for w, x in at.groupby(np.concatenate([[], *paths.words]).astype(object))}
                found = []
                for query, some in asks.items():
                    hits = [files[w] for w in some if w in files]
                    matched = np.bincount(np.concatenate(hits), minlength=n) if hits else np.zeros(n, np.int64)
                    top = np.flatnonzero(matched)
                    top = top[np.lexsort((top, -matched[top]))[:k]]
                    found.append(pd.DataFrame({"query": query, "path": paths.path.to_numpy()[top], "matched": matched[top]}))
                yield pd.concat([pd.DataFrame({"query": [], "path": [], "matched": []}), *[x for x in found if len(x)]], ignore_index=True).astype({"matched": "int64"})

        found = held.groupBy("path").agg(F.collect_set("word").alias("words")).mapInPandas(best, "query string, path string, matched long")
    else:
        parts = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))))
        met = held.distinct().withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(WORD_SALTS)).cast("int")).join(parts, ["word", "salt"])
        found = met.groupBy("query", "path").agg(F.count("*").alias("matched"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("matched"), "path"))).where(F.col("rank") <= k).select("query", "path", "matched", "rank")


def ir_measures(hits: DataFrame, queries: DataFrame, gold: Column) -> DataFrame:
    """One row: queries, recall@5, recall@10, mean reciprocal rank and single-slot nDCG@10; queries without a hit count 0."""
    first = hits.where(gold).groupBy("query").agg(F.min("rank").alias("first"))
    r = queries.select(F.col("id").alias("query")).join(first, "query", "left")
    at = lambda n, v: F.round(F.avg(F.when(F.col("first") <= n, v).otherwise(0.0)), 6)
    return r.agg(F.count("*").alias("n"), at(5, 1.0).alias("recall_5"), at(10, 1.0).alias("recall_10"), at(10**9, 1 / F.col("first")).alias("mrr"), at(10, 1 / F.log2(F.col("first") + 1)).alias("ndcg_10"))


def embed_udf(embedder, dim: int):  # noqa: ANN001, ANN201
    """A pandas UDF over text for any object with embed(list of text) -> list of vectors; one instance serves a whole task."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.asarray(v, np.float32)[:dim] for v in embedder.embed(texts.fillna("").tolist())])

    return run


class HashingEmbedder:
    """A deterministic embedder without a model: signed hashes of words, normalised. For tests and offline use."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        import re
        import zlib

        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Hits (key, rank) with the columns of their rows, in order of rank; hits without a row are dropped."""
    return hits.join(rows, key).orderBy("rank")


def check_collection(vectors: DataFrame, dim: int, column: str = "vector") -> str:
    """'' if a collection has a vector column of one length, else what is wrong: 'missing', 'legacy' (no array) or 'dimension'."""
    if column not in vectors.columns:
        return "missing"
    if not vectors.schema[column].dataType.typeName() == "array":
        return "legacy"
    wrong = vectors.where(F.col(column).isNotNull() & (F.size(column) != dim)).limit(1).count()
    return "dimension" if wrong else ""


def render_pack(pack: DataFrame) -> DataFrame:
    """section, text: a context pack (section, rank, title, score, negated) as one text per section, a line for each hit."""
    flag = F.when(F.coalesce("negated", F.lit(False)), " NEGATED").otherwise("")
    line = F.concat(F.lit("- "), F.substring("title", 1, 120), flag, F.format_string(" (%.3f)", F.col("score")))
    held = pack.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return held.select("section", F.concat(F.lit("## "), "section", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def percent_change(old: Column, new: Column) -> Column:
    """By how much new differs from old in percent, to one decimal; null for an old value of 0."""
    return F.round(F.try_divide(100 * (new - old), old), 1)
