"""Overlapping and gapped intervals per entity, merged by a mergeable aggregate of sorted disjoint lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The end of an interval that is still open.
OPEN = (1 << 63) - 1
#: Width of a slab in seconds. Disjoint intervals of whole seconds that start in one slab are at most half as many,
#: 302,400, as each needs a second and a gap: the proven bound of any list held in memory.
SLAB_SECONDS = 7 * 86_400
#: Partial lists that are merged at once at a level of the tree, and intervals that a partition holds before it lets go of them.
FAN_IN, HELD = 16, 1_000_000

_LISTS = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])


def merge_sorted(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals from intervals sorted by start, in one linear pass; those that touch become one."""
    if len(starts) < 2:
        return starts, ends
    reach = np.maximum.accumulate(ends)
    at = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[at], reach[np.concatenate((at[1:] - 1, [len(starts) - 1]))]


def _merge_two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Linear merge of two sorted disjoint lists: each one's places among the other's are found, then both are read once."""
    (s, e), (t, f) = a, b
    at = np.searchsorted(s, t, "right") + np.arange(len(t))
    starts, ends, own = np.empty(len(s) + len(t), np.int64), np.empty(len(s) + len(t), np.int64), np.ones(len(s) + len(t), bool)
    own[at] = False
    starts[at], ends[at], starts[own], ends[own] = t, f, s, e
    return merge_sorted(starts, ends)


def merge_lists(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted disjoint list from several, merged in pairs."""
    while len(lists) > 1:
        lists = [_merge_two(*lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    return lists[0]


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition, the disjoint list of each (entity, slab) in it; more than one only if it holds over HELD intervals."""
    held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def out() -> pd.DataFrame:
        return pd.DataFrame({"entity": [k[0] for k in held], "slab": [k[1] for k in held], "starts": [v[0] for v in held.values()], "ends": [v[1] for v in held.values()]})

    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.sort_values(["entity", "slab", "s"], kind="stable")
        entity, slab, s, e = pdf.entity.to_numpy(), pdf.slab.to_numpy(), pdf.s.to_numpy(np.int64), pdf.e.to_numpy(np.int64)
        at = np.flatnonzero(np.concatenate(([True], (entity[1:] != entity[:-1]) | (slab[1:] != slab[:-1]))))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(s)], strict=True):
            key = (entity[a], slab[a])
            old, new = held.get(key), merge_sorted(s[a:b], e[a:b])
            held[key] = new if old is None else _merge_two(old, new)
            size += len(held[key][0]) - (0 if old is None else len(old[0]))
        if size > HELD:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


@F.pandas_udf(_LISTS)
def _merge_udf(lists: pd.Series) -> pd.DataFrame:
    merged = [merge_lists([(np.asarray(x["starts"], np.int64), np.asarray(x["ends"], np.int64)) for x in row]) for row in lists]
    return pd.DataFrame({"starts": [m[0] for m in merged], "ends": [m[1] for m in merged]})


def disjoint_lists(intervals: DataFrame, slab_seconds: int = SLAB_SECONDS, fan_in: int = FAN_IN) -> DataFrame:
    """The aggregate: entity, slab, starts, ends, where a slab's list has the sorted disjoint intervals that start in it.

    intervals: entity STRING, s LONG, e LONG with s < e. Every partition first merges what it holds of an (entity, slab).
    The partial lists go through a tree whose depth follows the number of partitions: at each level those of `fan_in`
    neighbouring partitions are merged, at the last one all that are left. Merging is associative and commutative, so the
    result doesn't depend on the partitions.
    """
    rows = intervals.select("entity", F.floor(F.col("s") / slab_seconds).alias("slab"), "s", "e")
    leaves = rows.rdd.getNumPartitions()
    partial = rows.mapInPandas(_partial, "entity string, slab long, starts array<long>, ends array<long>").withColumn("leaf", F.spark_partition_id())

    def level(df: DataFrame, *by: str) -> DataFrame:
        lists = df.groupBy(*by).agg(F.collect_list(F.struct("starts", "ends")).alias("lists"))
        return lists.select(*by, _merge_udf("lists").alias("m")).select(*by, "m.starts", "m.ends")

    while leaves > fan_in:
        leaves = -(-leaves // fan_in)
        partial = level(partial.withColumn("leaf", F.floor(F.col("leaf") / fan_in)), "entity", "slab", "leaf")
    return level(partial, "entity", "slab")


def _rows(kind: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("from_s"), end.cast("long").alias("to_s"))


def periods_and_gaps(lists: DataFrame) -> DataFrame:
    """entity, kind ('period' or 'gap'), from_s, to_s (OPEN for an open period), from the lists of disjoint_lists().

    Slabs are joined by windows over one row per (entity, slab), a number bounded by the time span: the greatest end
    so far is carried into a slab and absorbs the intervals that start at or before it; the last period that begins in
    a slab ends where the next slab with a new start says that the carried period ends.
    """
    so_far = W.partitionBy("entity").orderBy("slab")
    whole = W.partitionBy("entity")
    carried = (
        lists.withColumn("max_end", F.array_max("ends"))
        .withColumn("carry", F.max("max_end").over(so_far.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("last_end", F.max("max_end").over(whole))
        .withColumn("l", F.arrays_zip("starts", "ends"))
    )
    split = carried.select(
        "entity", "slab", "carry", "last_end",
        F.filter("l", lambda x: F.col("carry").isNull() | (x["starts"] > F.col("carry"))).alias("new"),
        F.greatest("carry", F.array_max(F.transform(F.filter("l", lambda x: x["starts"] <= F.col("carry")), lambda x: x["ends"]))).alias("reach"),
    ).where(F.size("new") > 0)
    ended = split.withColumn("tail_end", F.coalesce(F.lead("reach").over(so_far), "last_end"))
    n = F.size("new")
    # Of the periods that begin in a slab all but the last also end there; each gap is reported with the period after it.
    periods = F.transform("new", lambda x, i: _rows("period", x["starts"], F.when(i == n - 1, F.greatest(x["ends"], F.col("tail_end"))).otherwise(x["ends"])))
    gaps = F.transform("new", lambda x, i: _rows("gap", F.when(i == 0, F.col("reach")).otherwise(F.element_at(F.col("new"), F.greatest(i, F.lit(1)))["ends"]), x["starts"]))
    return (
        ended.select("entity", F.explode(F.concat(periods, gaps)).alias("r"))
        .select("entity", "r.*")
        .where("from_s is not null")
    )


def to_seconds(value: Column) -> Column:
    """Whole epoch seconds of a time in seconds or, above 1e11, in milliseconds. NaN becomes null."""
    return F.when(F.isnan(value), None).when(value > 1e11, F.floor(value / 1000)).otherwise(F.floor(value))


def claim_intervals(claims: DataFrame) -> DataFrame:
    """entity, s, e of the claims that count.

    Subjects are compared in lower case without outer white space. Rows with a null subject, a null, NaN or infinite
    valid_at, a NaN valid_to, or valid_to at or before valid_at don't count; a null or infinite valid_to is open.
    """
    rows = claims.select(
        F.lower(F.regexp_replace("subject", r"^[\s ]+|[\s ]+$", "")).alias("entity"),
        F.when(F.abs("valid_at") != float("inf"), to_seconds(F.col("valid_at"))).alias("s"),
        F.when(F.col("valid_to").isNull() | (F.col("valid_to") == float("inf")), F.lit(OPEN)).otherwise(to_seconds(F.col("valid_to"))).alias("e"),
    )
    return rows.where("entity is not null and s is not null and e > s")


def claim_periods(claims: DataFrame, slab_seconds: int = SLAB_SECONDS) -> DataFrame:
    """subject, kind, from_s, to_s: the unbroken periods of each subject and the gaps between them; to_s is -1 if open.

    All predicates count together. Repeated rows, late rows and extra columns change nothing; an empty table or one
    without valid rows gives no rows.
    """
    found = periods_and_gaps(disjoint_lists(claim_intervals(claims), slab_seconds))
    return found.select(F.col("entity").alias("subject"), "kind", "from_s", F.when(F.col("to_s") == OPEN, F.lit(-1)).otherwise(F.col("to_s")).cast("long").alias("to_s"))
