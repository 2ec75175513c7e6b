"""The change feed: coalescing of file events and their effect on the tables, by batch or stream."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Which event of one window wins.
PRIORITY = {"delete": 3, "change": 2, "create": 1}


def coalesce(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One event for each path (or keys): delete before change before create, then the last; and last_seq."""
    keys = keys or ["path"]
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("event"))
    return changes.filter(F.col("event").isin(*PRIORITY)).groupBy(*keys).agg(F.max_by("event", F.struct(rank, "seq")).alias("event"), F.max("seq").alias("last_seq"))


def debounced(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Event-time form: a path's events less than gap apart are one window, which closes when the watermark passes."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("event"))
    sessions = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "path")
    return sessions.agg(F.max_by("event", F.struct(rank, "seq")).alias("event"), F.max("seq").alias("last_seq")).select(F.col("session_window.start").alias("start"), "path", "event", "last_seq")


def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths to analyse again, and paths that are gone."""
    events = coalesce(batch)
    return events.filter("event <> 'delete'").select("path"), events.filter("event = 'delete'").select("path")


def run(changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, interval: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Calls apply(to analyse, gone, batch id) for each micro-batch, which is one debounce window.

    A batch that is tried again has the same id, so apply writes under it.
    """

    def each(batch: DataFrame, n: int) -> None:
        again, gone = split(batch)
        apply(again, gone, n)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(checkpoint, "changes"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
