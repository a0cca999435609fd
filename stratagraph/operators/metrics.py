"""The metrics warehouse: summaries of retrievals, tools, sessions and backends, and islands of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """x if it is a usable measurement: not null, NaN, infinite or negative."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def summary(retrieves: DataFrame) -> DataFrame:
    """One row: count, averages of total, embed and code search times, sums of hits, last ts. Each id once (its last ts)."""
    once = retrieves.groupBy("id").agg(F.max(F.struct("ts", "total_ms", "embed_ms", "code_search_ms", "code_hit_count", "eps_hit_count", "claims_hit_count")).alias("r")).select("r.*")
    mean = lambda c: F.round(F.coalesce(F.avg(number(F.col(c))), F.lit(0.0)), 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return once.agg(
        F.count("*").alias("n"), mean("total_ms").alias("avg_total_ms"), mean("embed_ms").alias("avg_embed_ms"), mean("code_search_ms").alias("avg_code_ms"),
        total("code_hit_count").alias("code_hits"), total("eps_hit_count").alias("eps_hits"), total("claims_hit_count").alias("claims_hits"), F.max("ts").alias("last_ts"),
    )


def report(retrieves: DataFrame, cache_stats: DataFrame, ingest_stats: DataFrame) -> DataFrame:
    """One row: retrievals and their average time, hits, misses and hit ratio of the cache, builds, symbols and the last build.

    cache_stats: hits, misses; ingest_stats: symbols, ts. Sums of nothing are 0, the last ts of nothing is null.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    r = summary(retrieves).select(F.col("n").alias("retrieves"), "avg_total_ms")
    c = cache_stats.agg(total("hits").alias("cache_hits"), total("misses").alias("cache_misses")).withColumn("hit_ratio", F.round(F.coalesce(F.try_divide(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses")), F.lit(0.0)), 3))
    i = ingest_stats.agg(F.count("*").alias("ingests"), total("symbols").alias("symbols"), F.max("ts").alias("last_ingest_ts"))
    return r.crossJoin(c).crossJoin(i)  # three tables of one row


def latest_status(health: DataFrame) -> DataFrame:
    """backend, status, ts of the latest row of each backend (names in lower case without outer blanks; ties by id)."""
    return health.where("backend is not null and ts is not null").groupBy(F.lower(F.trim("backend")).alias("backend")).agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("ts").alias("ts"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls, characters and their average per project and tool, with totals (null tool, null project)."""
    return calls.rollup("project", "tool").agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.round(F.avg("chars"), 3).alias("avg_chars"))


def efficiency(tools: DataFrame, reads: DataFrame) -> DataFrame:
    """session, tool_chars, read_chars, share: what each session got from tools and from reading files itself."""
    t = tools.groupBy("session").agg(F.sum("chars").alias("tool_chars"))
    r = reads.groupBy("session").agg(F.sum("chars").alias("read_chars"))
    both = t.join(r, "session", "full_outer").select("session", F.coalesce("tool_chars", F.lit(0)).alias("tool_chars"), F.coalesce("read_chars", F.lit(0)).alias("read_chars"))
    return both.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("tool_chars"), F.col("tool_chars") + F.col("read_chars")), F.lit(0.0)), 6))


def latency_quantiles(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """by..., n, p50, p95: the median, and the 19th of the 20-quantiles of the exclusive method, with fewer than 20 values the maximum.

    Values are counted first, then cut into ranges of their own order of magnitude. The counts of the ranges, a few hundred for
    a group, say how many values lie before each, so that ranks are numbered within a range and no group is sorted in one task.
    """
    v = rows.select(*by, number(F.col(x)).alias("x")).where("x is not null")
    # Sixteenths of powers of two: the range of a value grows with it. Zero has its own.
    scale = F.when(F.col("x") > 0, F.floor(16 * F.log2("x")).cast("int")).otherwise(F.lit(-1 << 30))
    counted = v.groupBy(*by, "x").agg(F.count("*").alias("c")).withColumn("range", scale)
    ranges = counted.groupBy(*by, "range").agg(F.sum("c").alias("in_range"))
    before = F.sum("in_range").over(W.partitionBy(*by).orderBy("range")) - F.col("in_range")
    placed = ranges.select(*by, "range", before.alias("before"), F.sum("in_range").over(W.partitionBy(*by)).alias("n"))
    upto = F.col("before") + F.sum("c").over(W.partitionBy(*by, "range").orderBy("x"))
    # A value holds the ranks from r - c + 1 to r.
    ranked = counted.join(placed, [*by, "range"]).withColumn("r", upto)
    spot = 0.95 * (F.col("n") + 1)
    j, part = F.floor(spot), spot - F.floor(spot)
    at = lambda k: F.max(F.when((k > F.col("r") - F.col("c")) & (k <= F.col("r")), F.col("x")))
    out = ranked.groupBy(*by, "n").agg(at(F.floor((F.col("n") + 1) / 2)).alias("a"), at(F.floor(F.col("n") / 2) + 1).alias("b"), at(j).alias("c"), at(j + 1).alias("d"), F.max("x").alias("m"))
    return out.select(*by, "n", F.round((F.col("a") + F.col("b")) / 2, 6).alias("p50"), F.round(F.when(F.col("n") < 20, F.col("m")).otherwise(F.col("c") * (1 - part) + F.col("d") * part), 6).alias("p95"))


def debounce(events: DataFrame, key: str, gap: str) -> DataFrame:
    """key, started, fired, n: bursts of events without a pause of `gap`; each fires once, `gap` after its last event (epoch seconds)."""
    s = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.unix_micros("w.start").alias("started"), F.unix_micros("w.end").alias("fired"), "n")


def breaker_states(events: DataFrame, key: str, failed: Column, threshold: int, open_seconds: float) -> DataFrame:
    """The events with state: what a breaker would have let each of them meet, 'closed', 'open' or 'half_open'.

    It opens at the threshold-th failure in a row. For open_seconds after it every call is refused ('open', and doesn't count);
    the first one later is a trial ('half_open') that closes it or opens it for as long again. ts is in seconds. The state
    depends on all events before, so a key's events are taken in order, batch by batch, and only three numbers are held of them.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(k: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_, until, state = 0, None, "closed"
        for pdf in parts:
            states = []
            for ts, bad in zip(pdf.ts, pdf["_failed"], strict=True):
                if state == "open" and ts < until:
                    states.append("open")
                    continue
                met = "half_open" if state == "open" else "closed"
                states.append(met)
                run_ = run_ + 1 if bad else 0
                state = "open" if bad and (met == "half_open" or run_ >= threshold) else "closed"
                until = ts + open_seconds if state == "open" else None
            yield pdf.drop(columns="_failed").assign(state=states)

    # Sorted by key and time within the partitions of the keys: applyInPandas() over batches keeps that order.
    rows = events.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", state string"

    def by_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import itertools

        def pieces() -> Iterator[tuple[object, pd.DataFrame]]:
            for pdf in batches:
                for k, part in pdf.groupby(key, sort=False, dropna=False):
                    yield k, part

        for k, some in itertools.groupby(pieces(), key=lambda p: "null" if pd.isna(p[0]) else p[0]):
            yield from run((k,), (p for _, p in some))

    return rows.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(by_key, schema)


def breaker(events: DataFrame, key: str, failed: Column, threshold: int) -> DataFrame:
    """key, opened: when a run of consecutive failures reached the threshold, i.e. when a breaker would have opened."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    runs = events.withColumn("f", failed.cast("int")).withColumn("run", F.sum(F.when(F.col("f") == 1, 0).otherwise(1)).over(w))
    nth = runs.where("f = 1").withColumn("nth", F.row_number().over(W.partitionBy(key, "run").orderBy("ts", "event_id")))
    return nth.where(F.col("nth") == threshold).select(key, F.col("event_id").alias("opened"))


def turn_gate(events: DataFrame, key: str, prompt: Column, memory: Column, gated: Column) -> DataFrame:
    """key, turn, event_id of the first gated call of a turn that no memory call of that turn came before."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    turns = events.withColumn("turn", F.sum(prompt.cast("int")).over(w))
    first = turns.groupBy(key, "turn").agg(
        F.min(F.when(gated, F.struct("ts", "event_id"))).alias("g"), F.min(F.when(memory, F.struct("ts", "event_id"))).alias("m")
    )
    return first.where("g is not null and (m is null or g < m)").select(key, "turn", F.col("g.event_id").alias("event_id"))


def session_episodes(events: DataFrame, key: str, prompt: Column, text: str) -> DataFrame:
    """key, text, verdict: what a stop hook records of each session: its first prompt, as idle."""
    return events.where(prompt).groupBy(key).agg(F.min_by(text, F.struct("ts", "event_id")).alias("text")).withColumn("verdict", F.lit("idle"))
