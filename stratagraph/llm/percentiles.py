"""Exact order statistics per group by distributed multi-select, and summaries of them that can be combined.

Values stay where they are, as sorted arrays per partition and group. In each round every array proposes the median of
what is left of it, the weighted median of the proposals becomes the pivot of its group and target rank, the arrays are
counted three ways against it, and the ranges that are ruled out are discarded; all groups and ranks share the rounds.
Groups of every size take these rounds. Those whose arrays fit into one task are taken through them there; of larger ones
only counts and proposals are sent, and each round is a job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.runtime import bounded_broadcast, cut

#: Values of one sorted array at most, and partitions whose counts and proposals are combined at once.
ARRAY, FAN_IN = 65_536, 256
#: Values of a group whose arrays are brought into one task.
TOGETHER = 65_536
#: Open targets (of some 40 bytes each) that are broadcast; more of them are joined by a shuffle.
BROADCAST_TARGETS = 500_000
#: Rounds after which what is ruled out is taken out of the arrays.
TRIM = 4
#: Ranks of a ladder: a group's summary is the values at so many even ranks and its ends.
RUNGS = 200
#: The percentiles asked for.
PERCENTS = (50, 90, 95, 99)


def nearest_rank(n: np.ndarray | int, percent: float) -> np.ndarray | int:
    """Rank (from 1) of a percentile by the nearest-rank rule: the least rank that is at least percent / 100 * n."""
    return np.maximum(1, -(-np.asarray(n, np.int64) * round(percent * 1000) // 100_000))


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted arrays per group from a partition: groups are gathered over batches and let go of when they are full."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    total = 0

    def out(names: list[str]) -> pd.DataFrame:
        rows = [(g, np.sort(np.concatenate(held.pop(g)))) for g in names]
        for g in names:
            sizes.pop(g)
        return pd.DataFrame({"g": [g for g, _ in rows], "xs": [x for _, x in rows]})

    for pdf in batches:
        for g, x in pdf.groupby("g", sort=False)["x"]:
            held.setdefault(g, []).append(x.to_numpy(np.float64))
            sizes[g] = sizes.get(g, 0) + len(x)
        total = sum(sizes.values())
        full = [g for g, n in sizes.items() if n >= ARRAY] if total < 16 * ARRAY else list(sizes)
        if full:
            yield out(full)
    if sizes:
        yield out(list(sizes))


_STATS = "g string, part int, t int, lt long, eq long, gt long, m_lt double, m_gt double"
_STAT_NAMES = ["g", "part", "t", "lt", "eq", "gt", "m_lt", "m_gt"]


def _range(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values strictly between lo and hi (NaN: without bound) begin and end in the sorted array x, for each target."""
    a = np.where(np.isnan(lo), 0, np.searchsorted(x, lo, "right"))
    return a, np.maximum(a, np.where(np.isnan(hi), len(x), np.searchsorted(x, hi, "left")))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each row of a list column, without a copy."""
    x, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [x[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _three_way(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per target how many values of its range are below, at and above its pivot, and the lower medians of both sides (NaN if empty)."""
    a, b = _range(x, lo, hi)
    c, d = (np.minimum(np.maximum(np.searchsorted(x, pivot, s), a), b) for s in ("left", "right"))
    return c - a, d - c, b - d, np.where(c > a, x[np.maximum(a + c - 1, 0) // 2], np.nan), np.where(b > d, x[np.minimum((d + b - 1) // 2, len(x) - 1)], np.nan)


def _weighted_medians(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per column the weighted lower median of proposals m with weights w; NaN where all weights are 0."""
    order = np.argsort(m, axis=0, kind="stable")
    upto = np.cumsum(np.take_along_axis(w, order, 0), 0)
    at = np.argmax(upto >= np.maximum(1, (upto[-1] + 1) // 2), 0)
    return np.take_along_axis(np.take_along_axis(m, order, 0), at[None, :], 0)[0]


def select_together(arrays: list[np.ndarray], ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """The values at the ranks (from 1) of all arrays together, each of which is sorted, and the number of rounds."""
    t = np.arange(len(ranks))
    k, lo, hi, pivot = ranks.copy(), np.full(len(t), np.nan), np.full(len(t), np.nan), np.full(len(t), -np.inf)
    values, rounds = np.empty(len(t)), 0
    while len(t):
        rounds += 1
        lt, eq, gt, m_lt, m_gt = (np.stack(c) for c in zip(*(_three_way(x, lo, hi, pivot) for x in arrays), strict=True))
        p_lt, p_gt = _weighted_medians(m_lt, lt), _weighted_medians(m_gt, gt)
        below, upto = lt.sum(0), lt.sum(0) + eq.sum(0)
        lower, here = k <= below, (k > below) & (k <= upto)
        values[t[here]] = pivot[here]
        k, lo, hi, pivot = np.where(lower, k, k - upto), np.where(lower, lo, pivot), np.where(lower, pivot, hi), np.where(lower, p_lt, p_gt)
        t, k, lo, hi, pivot = (c[~here] for c in (t, k, lo, hi, pivot))
    return values, rounds


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, rank, value of groups whose arrays are together: g, ranks, arrays."""
    for batch in batches:
        rows, ranks = [np.array([], np.int64)], [np.array([], np.int64)]
        values = [np.array([])]
        inner = batch.column("arrays").values
        parts, at = _lists(inner), batch.column("arrays").offsets.to_numpy()
        for row, wanted in enumerate(_lists(batch.column("ranks"))):
            rows.append(np.full(len(wanted), row)), ranks.append(wanted)
            values.append(select_together(parts[at[row] : at[row + 1]], wanted)[0])
        yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(values))], ["g", "rank", "value"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per array and open target: the three-way count within its range, and the medians of both sides as proposals."""
    for batch in batches:
        rows, found = [np.array([], np.int64)], [np.empty((4, 0), np.int64)]
        proposals = [np.empty((2, 0))]
        columns = [_lists(batch.column(c)) for c in ("xs", "t", "lo", "hi", "pivot")]
        for row, (x, t, lo, hi, pivot) in enumerate(zip(*columns, strict=True)):
            lt, eq, gt, m_lt, m_gt = _three_way(x, lo, hi, pivot)
            rows.append(np.full(len(t), row)), found.append(np.stack((t, lt, eq, gt))), proposals.append(np.stack((m_lt, m_gt)))
        row, (t, lt, eq, gt), (m_lt, m_gt) = np.concatenate(rows), np.concatenate(found, 1), np.concatenate(proposals, 1)
        some = np.flatnonzero(lt + eq + gt)
        at = pa.array(row[some])
        numbers = [t[some].astype(np.int32), lt[some], eq[some], gt[some], m_lt[some], m_gt[some]]
        yield pa.RecordBatch.from_arrays([batch.column("g").take(at), batch.column("part").take(at), *map(pa.array, numbers)], _STAT_NAMES)


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays without the values that no open target's range has; arrays without such values end here."""
    for batch in batches:
        kept = []
        for x, lo, hi in zip(*[_lists(batch.column(c)) for c in ("xs", "lo", "hi")], strict=True):
            a, b = _range(x, lo, hi)
            inside = np.zeros(len(x) + 1, np.int64)
            np.add.at(inside, a, 1)
            np.add.at(inside, b, -1)
            kept.append(x[np.cumsum(inside)[:-1] > 0])
        some = [i for i, x in enumerate(kept) if len(x)]
        at = pa.array(some, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("g").take(at), batch.column("part").take(at), pa.array([kept[i] for i in some], pa.list_(pa.float64()))], ["g", "part", "xs"])


def _weighted_median(value: str, weight: str) -> str:
    """The weighted lower median of the proposals of a group, as SQL of an aggregate (one call to the JVM instead of dozens a round)."""
    return f"""aggregate(sort_array(collect_list(if({weight} > 0, struct({value} as v, {weight} as w), null))),
        named_struct('upto', 0L, 'half', (sum({weight}) + 1) div 2, 'v', cast(null as double)),
        (s, x) -> named_struct('upto', s.upto + x.w, 'half', s.half, 'v', if(s.v is null and s.upto + x.w >= s.half, x.v, s.v)), s -> s.v)"""


_COMBINED = ("sum(lt) as lt", "sum(eq) as eq", "sum(gt) as gt", _weighted_median("m_lt", "lt") + " as m_lt", _weighted_median("m_gt", "gt") + " as m_gt")
# What a round leaves of a target: with its rank at or below lt the lower side, above lt + eq the upper one, else the pivot is it.
_AFTER = (
    "g", "t", "rank", "if(k <= lt, k, k - lt - eq) as k", "if(k <= lt, lo, pivot) as lo", "if(k <= lt, pivot, hi) as hi",
    "if(k <= lt, m_lt, m_gt) as pivot", "if(k > lt and k <= lt + eq, pivot, null) as value",
)


def _rank(n: Column, percent: float) -> Column:
    """nearest_rank() as an expression, in whole numbers."""
    return F.greatest(F.lit(1).cast("long"), F.expr("cast(0 as bigint)") + F.call_function("div", n * F.lit(round(percent * 1000)).cast("long") + F.lit(99_999), F.lit(100_000).cast("long")))


def _with_targets(arrays: DataFrame, state: DataFrame, salts: int, few: bool) -> DataFrame:
    """Arrays beside the open targets of their group: t, lo, hi, pivot as arrays. Targets are broadcast if they are few."""
    targets = state.groupBy("g").agg(F.expr("sort_array(collect_list(struct(t, lo, hi, pivot)))").alias("o")).selectExpr("g", "o.t", "o.lo", "o.hi", "o.pivot", f"explode(sequence(0, {salts - 1})) as salt")
    return arrays.selectExpr("*", f"pmod(part, {salts}) as salt").join(F.broadcast(targets) if few else targets, ["g", "salt"])


def round_stats(met: DataFrame, parts: int) -> DataFrame:
    """g, t, lt, eq, gt, m_lt, m_gt over all arrays: counts added up, proposals joined by their weighted medians.

    Arrays of up to FAN_IN partitions are combined at once, more of them in levels; a weighted median of weighted medians
    still rules out a fixed share of what is left.
    """
    stats = met.select("g", "part", "xs", "t", "lo", "hi", "pivot").mapInArrow(_count, _STATS)

    combined = [F.expr(c) for c in _COMBINED]
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        stats = stats.selectExpr("g", "t", f"part div {FAN_IN} as part", "lt", "eq", "gt", "m_lt", "m_gt").groupBy("g", "t", "part").agg(*combined)
    return stats.groupBy("g", "t").agg(*combined)


def multi_select(values: DataFrame, percents: Sequence[float] = PERCENTS, rungs: int = 0) -> DataFrame:
    """g, t, rank, n, value: the exact value at each asked rank of each group.

    values: g STRING, x DOUBLE without null and NaN. t < len(percents) is a percentile by the nearest-rank rule; with
    rungs > 0, t from len(percents) on are the ranks 1 and ceil(n * i / rungs) of a ladder. Ranks that several t ask for are
    searched once. Groups of up to TOGETHER values take their rounds in one task (select_together()). Rounds end when all ranks are found, which takes about log(n) of them. Equal values are counted, not told
    apart, so ties end a search early. A hot group is as many arrays as partitions hold of it. An empty input gives none.
    """
    arrays = cut(values.select("g", "x").mapInPandas(_arrays, "g string, xs array<double>").withColumn("part", F.spark_partition_id()))
    parts = arrays.rdd.getNumPartitions()
    salts, most = -(-parts // FAN_IN), len(percents) + (rungs + 1 if rungs else 0)
    n = F.col("n")
    ranks = [_rank(n, p) for p in percents] + ([F.lit(1).cast("long"), *(F.call_function("div", n * i + (rungs - 1), F.lit(rungs).cast("long")) for i in range(1, rungs + 1))] if rungs else [])
    groups = cut(arrays.groupBy("g").agg(F.sum(F.size("xs").cast("long")).alias("n")).select("g", "n", F.array(*ranks).alias("ks")))
    wanted = groups.select("g", "n", F.posexplode("ks").alias("t", "rank"))
    few = bounded_broadcast(groups.select("g", F.array_distinct("ks").alias("ranks"), "n"), BROADCAST_TARGETS // most)
    together = arrays.join(few.where(F.col("n") <= TOGETHER), "g").groupBy("g").agg(F.first("ranks").alias("ranks"), F.collect_list("xs").alias("arrays"))
    in_tasks = together.mapInArrow(_select, "g string, rank long, value double")

    # The first pivot is below all values: its round only asks every array for its median.
    unbounded, large = F.lit(float("nan")), groups.where(n > TOGETHER).select("g")
    state = cut(wanted.where(n > TOGETHER).groupBy("g", "rank").agg(F.min("t").alias("t")).select("g", "t", "rank", F.col("rank").alias("k"), unbounded.alias("lo"), unbounded.alias("hi"), F.lit(float("-inf")).alias("pivot"), F.lit(None).cast("double").alias("value")))
    done, rounds = [in_tasks], 0
    while open_ := state.count():
        if not rounds:
            arrays = cut(arrays.join(bounded_broadcast(large), "g", "left_semi"))
        few = open_ * salts <= BROADCAST_TARGETS
        met = _with_targets(arrays, state, salts, few)
        if rounds and rounds % TRIM == 0:
            arrays = cut(met.select("g", "part", "xs", "lo", "hi").mapInArrow(_trim, "g string, part int, xs array<double>"))
            met = _with_targets(arrays, state, salts, few)
        rounds += 1
        after = cut(state.join(round_stats(met, parts), ["g", "t"]).selectExpr(*_AFTER))
        done.append(after.where("value is not null").select("g", "rank", "value"))
        state = after.where("value is null")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return wanted.join(found, ["g", "rank"]).select("g", "t", "rank", "n", "value")


def ladders(selected: DataFrame, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """g, n, rungs (array of value and weight): the mergeable summary of each group, from multi_select(..., rungs=RUNGS).

    A rung's weight is the number of ranks from the rung before (excluded) to it, so the weights of a group add up to n.
    The true rank of any value differs from the weights up to it by less than n / RUNGS + 1.
    """
    rungs = selected.where(F.col("t") >= len(percents)).groupBy("g", "n").agg(F.sort_array(F.collect_set(F.struct("rank", "value"))).alias("r"))
    weighted = F.transform("r", lambda x, i: F.struct(x["value"].alias("value"), (x["rank"] - F.when(i == 0, F.lit(0)).otherwise(F.col("r")[F.greatest(i - 1, F.lit(0))]["rank"])).alias("weight")))
    return rungs.select("g", "n", weighted.alias("rungs"))


def combine(parts: DataFrame, by: Sequence[str], percents: Sequence[float] = PERCENTS) -> DataFrame:
    """by..., percent, value, n, rank_error: percentiles of groups of ladders (months of days, totals of months).

    parts: the columns of `by`, n and rungs. Ladders are combined by adding up the weights of equal values. rank_error
    is the proven bound: each part of n_i values adds less than n_i / RUNGS + 1 ranks.
    """
    bound = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.floor(F.col("n") / RUNGS) + 1).alias("rank_error"))
    weights = parts.select(*by, F.explode("rungs").alias("r")).groupBy(*by, F.col("r.value").alias("value")).agg(F.sum("r.weight").alias("w"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value", kind="stable")
        upto = np.cumsum(pdf.w.to_numpy())
        at = np.minimum(np.searchsorted(upto, [nearest_rank(int(upto[-1]), p) for p in percents]), len(upto) - 1)
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "percent": list(percents), "value": pdf.value.to_numpy()[at]})

    types = dict(weights.dtypes)
    schema = ", ".join(f"{b} {types[b]}" for b in by) + ", percent double, value double"
    chosen = weights.groupBy(*by).applyInPandas(pick, schema)
    return chosen.join(bound, list(by)).select(*by, "percent", "value", "n", "rank_error")


def countable(value: Column) -> Column:
    """Values that count: not null, NaN, infinite or negative."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), F.lit(False))


def measures(retrieves: DataFrame, backend_health: DataFrame) -> DataFrame:
    """metric, backend ('' for retrieves), day (yyyy-MM-dd, UTC), x: every value that counts, each id once.

    Of rows with the same id the last by ts counts (ties by the greater values); backends are compared in lower case
    without outer blanks. Rows with a null id or ts, or a null backend, don't count.
    """
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day")
    # F.max_by orders NaN above all numbers and null below, the same for every run.
    r = retrieves.where("id is not null and ts is not null").groupBy("id").agg(F.max(F.struct("ts", "total_ms", "embed_ms")).alias("r")).select("r.*")
    r = r.select(day, F.explode(F.array(F.struct(F.lit("total_ms").alias("metric"), F.col("total_ms").alias("x")), F.struct(F.lit("embed_ms").alias("metric"), F.col("embed_ms").alias("x")))).alias("m"))
    h = backend_health.where("id is not null and ts is not null").groupBy("id").agg(F.max(F.struct("ts", "latency_ms", "backend")).alias("r")).select("r.*")
    h = h.select(F.lit("latency_ms").alias("metric"), F.lower(F.trim("backend")).alias("backend"), day, F.col("latency_ms").alias("x")).where("backend is not null")
    both = r.select("m.metric", F.lit("").alias("backend"), "day", "m.x").unionByName(h)
    return both.where(countable(F.col("x"))).withColumn("x", F.col("x") + F.lit(0.0))


_KEY = ("metric", "backend", "day")


def daily(values: DataFrame, rungs: int = 0) -> DataFrame:
    """multi_select() per metric, backend and day, with the group's columns beside g."""
    g = F.concat_ws("\u0001", *_KEY)
    selected = multi_select(values.select(g.alias("g"), "x"), rungs=rungs)
    part = F.split("g", "\u0001")
    return selected.select(*[part[i].alias(c) for i, c in enumerate(_KEY)], *[c for c in selected.columns])


def percentile_rows(selected: DataFrame, keys: Sequence[str], percents: Sequence[float] = PERCENTS) -> DataFrame:
    """keys..., percent, value, n: the percentiles of multi_select()."""
    percent = F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("t") + 1)
    return selected.where(F.col("t") < len(percents)).select(*keys, percent.alias("percent"), "value", "n")


def with_months(selected: DataFrame, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """metric, backend, grain ('month' or 'total'), period, percent, value, n, rank_error from daily ladders."""
    keys = selected.select("g", *_KEY).distinct()
    parts = cut(ladders(selected, percents).join(keys, "g"))
    rows = parts.select("metric", "backend", F.explode(F.array(F.struct(F.lit("month").alias("grain"), F.substring("day", 1, 7).alias("period")), F.struct(F.lit("total").alias("grain"), F.lit("all").alias("period")))).alias("p"), "n", "rungs")
    return combine(rows.select("metric", "backend", "p.grain", "p.period", "n", "rungs"), ["metric", "backend", "grain", "period"], percents)
