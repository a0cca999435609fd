"""Drawing documents so that every source fills its target share of all tokens.

Each source has a budget of tokens, and each of its documents the same expected number of copies. The whole part is
certain; the fractional parts are rounded by the pivotal method: two fractional documents play against each other,
moving expected tokens from one to the other at random until one of them is decided, which leaves the expected number
of copies of each document and the tokens of the source what they were. Documents play within buckets, the one that is
left undecided in a bucket plays on in the next level of a tree, and the last one of a source is drawn.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.runtime import bounded_broadcast, cut, spread

#: The vocabulary by whose tokens sizes are counted, a file for the `tokenizers` library.
TOKENIZER = os.environ.get("STRATAGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Documents that play in one bucket at the first level, and undecided ones at the levels above.
BUCKET, FAN_IN = 20_000, 64


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _sent(spark: SparkSession, path: str) -> None:
    """Sends the vocabulary to the executors, which need not have it where the driver has."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def _sizes(path: str):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = SparkFiles.get(os.path.basename(path))
        t = _tokenizer(sent if os.path.exists(sent) else path)
        for pdf in batches:
            tokens: list[int] = []
            for i in range(0, len(pdf), 256):
                tokens.extend(len(e) for e in t.encode_batch(pdf.text.iloc[i : i + 256].tolist(), add_special_tokens=False))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "tokens": np.array(tokens, np.int64)})

    return run


def spelling(source: Column) -> Column:
    """A source's name in one spelling: lower case, no outer blanks, '-' for '_'."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), "_", "-")


def token_sizes(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of the documents that take part: with a text, at least one token, and a source of `targets`.

    A doc_id given several times takes part once, with its greatest size.
    """
    names = bounded_broadcast(targets.select(spelling(F.col("source")).alias("source")).where("source is not null").distinct())
    rows = spread(documents.select("doc_id", "text", spelling(F.col("source")).alias("source")).where("doc_id is not null and text is not null and text <> ''")).join(names, "source", "left_semi")
    _sent(documents.sparkSession, tokenizer)
    sized = rows.mapInPandas(_sizes(tokenizer), "doc_id long, source string, tokens long").where("tokens > 0")
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_id", "m.source", "m.tokens")


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per source of `targets` its tokens and documents, the cap, its budget, and expected copies of each document.

    total is the wished number of tokens, by default as many as take part. A source that cannot fill its share, as all
    copies it may have are less, gets all of them, and what it leaves is divided among the others by their target shares;
    that is repeated until no other source is over its cap. The list has one entry for each source; sources are few.
    """
    held = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    wanted = targets.select(spelling(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = []
    for r in wanted.orderBy("source").collect():
        h = held.get(r["source"])
        tokens, docs = (int(h["tokens"]), int(h["docs"])) if h else (0, 0)
        rows.append({"source": r["source"], "target_share": max(0.0, r["target_share"] or 0.0), "max_repeats": max(0, r["max_repeats"] or 0), "tokens": tokens, "docs": docs, "capped": False})
    whole = sum(r["tokens"] for r in rows) if total is None else total
    for r in rows:
        r["cap"] = r["tokens"] * r["max_repeats"]
    open_ = list(rows)
    left = float(whole)
    while open_:
        share = sum(r["target_share"] for r in open_)
        over = [r for r in open_ if share <= 0 or r["target_share"] / share * left >= r["cap"]]
        if not over:
            for r in open_:
                r["budget"] = r["target_share"] / share * left
            break
        for r in over:
            r["budget"] = float(r["cap"]) if r["target_share"] > 0 else 0.0
            r["capped"] = r["target_share"] > 0
            left -= r["budget"]
        open_ = [r for r in open_ if r not in over]
        left = max(left, 0.0)
    for r in rows:
        r["copies"] = min(float(r["max_repeats"]), r["budget"] / r["tokens"]) if r["tokens"] else 0.0
    return rows


def _chance(seed: int, a: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from each id, the same in every run of a task."""
    x = a.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
        x ^= x >> np.uint64(27)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def pivotal(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the play: all 0 or 1 but for at most one. Keeps sum(p * sizes), and each p in expectation."""
    p, eps = p.copy(), 1e-12
    luck = _chance(seed, ids)
    held = -1
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        j, wi, wj = held, sizes[i], sizes[held]
        up = min((1 - p[i]) * wi, p[j] * wj)  # tokens that may move from j to i
        down = min(p[i] * wi, (1 - p[j]) * wj)
        move = up if luck[i] * (up + down) < down else -down
        p[i] += move / wi
        p[j] -= move / wj
        undecided = [x for x in (i, j) if eps < p[x] < 1 - eps]
        for x in (i, j):
            if x not in undecided:
                p[x] = round(p[x])
        held = undecided[0] if undecided else -1
    return p


_ROWS = "doc_id long, source string, tokens long, base long, p double, bucket long"


def _play(seed: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # By size, so that documents of like sizes play and a move decides nearly both; a small one is left undecided.
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=False, kind="stable")
        return pdf.assign(p=pivotal(pdf.doc_id.to_numpy(np.int64), pdf.tokens.to_numpy(np.float64), pdf.p.to_numpy(np.float64), seed))

    return run


def draw(sizes: DataFrame, plan: list[dict], seed: int = 11) -> DataFrame:
    """doc_id, source, tokens, copies of every document that takes part; copies may be 0 and are at most max_repeats.

    The same input, plan and seed give the same draw, whatever the partitions and retries: buckets depend on ids alone.
    """
    spark = sizes.sparkSession
    copies = spark.createDataFrame([(r["source"], float(r["copies"])) for r in plan] or [("", 0.0)], "source string, x double")
    most = max([r["docs"] for r in plan], default=0)
    buckets = max(1, -(-most // BUCKET))
    base = F.floor(F.col("x") + 1e-9)
    state = sizes.join(bounded_broadcast(copies), "source").select("doc_id", "source", "tokens", base.cast("long").alias("base"), F.greatest(F.col("x") - base, F.lit(0.0)).alias("p"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("long").alias("bucket"))
    done, level = [], 0
    while True:
        state = cut(state.groupBy("source", "bucket").applyInPandas(_play(seed + level), _ROWS))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~open_))
        state = state.where(open_)
        if buckets == 1:
            break
        buckets = -(-buckets // FAN_IN)
        state = state.withColumn("bucket", F.pmod("bucket", F.lit(buckets)).cast("long"))
        level += 1
    # At most one document of a source is still undecided; it is drawn with what it has.
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    done.append(state.withColumn("p", F.when(chance < F.col("p"), 1.0).otherwise(0.0)))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("doc_id", "source", "tokens", (F.col("base") + F.round("p")).cast("int").alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[dict]]:
    """The draw and its plan. Documents without text or with a source not in targets take no part; an empty table gives none."""
    sizes = cut(token_sizes(documents, targets, tokenizer))
    plan = budgets(sizes, targets, total)
    return draw(sizes, plan, seed), plan


def shares(drawn: DataFrame, plan: list[dict]) -> DataFrame:
    """Per source: docs and tokens that take part, tokens drawn, the share reached of all tokens drawn, target and cap.

    met says whether the share reached is at least 0.99 of the target; capped, that all copies allowed are drawn. Where a
    source falls short the others exceed their targets, all in the same proportion. A source without documents has a row
    with zeros.
    """
    spark = drawn.sparkSession
    rows = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["docs"], r["tokens"], float(r["budget"]), r["capped"]) for r in plan], "source string, target_share double, max_repeats int, docs long, tokens long, budget double, capped boolean")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_copies"), F.max("copies").alias("most_copies"))
    all_ = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = rows.join(bounded_broadcast(got), "source", "left").crossJoin(F.broadcast(all_))  # all_ is one row
    share = F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0))
    return joined.select("source", "target_share", "max_repeats", "docs", "tokens", "budget", "capped", zero("drawn_tokens"), zero("drawn_copies"), zero("most_copies"), share.alias("reached_share"), (share >= 0.99 * F.col("target_share")).alias("met"))
