"""Structured Streaming forms of the incremental operators.

State is bounded by watermarks: the reference has no notion of lateness, so how late an event may come is a parameter
here, and events later than that are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratagraph.sources.store import VersionedTable


def debounced(events: DataFrame, key: str, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """key, started, fired, n: one row per burst of events of a key, once no event came for `gap`. events: key, ts TIMESTAMP.

    Emitted in append mode when the watermark passes the end of the session; each event resets the timer.
    """
    w = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fired"), "n")


def breaker_openings(events: DataFrame, key: str, threshold: int = 5, late: str = "1 minute", idle: str = "1 day") -> DataFrame:
    """key, event_id: the event at which a key's run of consecutive failures reached the threshold. events: key, event_id, ts, failed.

    The state of a key is one counter; it is dropped after `idle` of event time without an event. Events are taken in
    order of time within each micro-batch.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (run,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        opened = []
        for event_id, failed in zip(rows.event_id, rows.failed, strict=True):
            run = run + 1 if failed else 0
            if run == threshold:
                opened.append(event_id)
        state.update((run,))
        state.setTimeoutTimestamp(int(rows.ts.max().timestamp() * 1000) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({key: [k[0]] * len(opened), "event_id": opened})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long", "run int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_into(stream: DataFrame, target: VersionedTable, key: list[str], order: str, checkpoint: str, trigger: dict | None = None):  # noqa: ANN201
    """Starts a query that merges each micro-batch into a versioned table: per key the row with the greatest `order` stays.

    A batch reads and writes only the buckets its keys are in. One that is run again after a failure writes the same rows
    again, so the result is the same.
    """

    def merge(batch: DataFrame, _: int) -> None:
        target.upsert(batch, key, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
