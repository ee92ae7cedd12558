"""The change feed as a stream over the log folder, and hot paths held back (HS3, HS8, HS10, HS14, HS15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notegraph.operators import history
from notegraph.sources.shared import SharedFolder


def source(spark: SparkSession, folder: str, schema: str, files: int = 64) -> DataFrame:
    """New files of the log as they arrive; the stream's checkpoint is the cursor over files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run(
    log: DataFrame,
    snapshot: Callable[[], DataFrame],
    apply: Callable[[DataFrame, int], None],
    cursor: Callable[[], int],
    save: Callable[[int], None],
    now_ms: Callable[[], int],
    checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Every micro-batch drains the settled part of the log after the cursor, so rows that land behind
    a gap wait until it is burned. Effects come before the cursor is saved: a batch that is repeated
    after a fault applies the same references again."""

    def batch(_: DataFrame, epoch: int) -> None:
        while True:
            after = cursor()
            page, upper = history.feed(snapshot(), after, now_ms())
            if upper == after:
                return
            apply(page, epoch)
            save(upper)

    writer = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def file_cursor(spark: SparkSession, folder: str, name: str = "cursor") -> tuple[Callable[[], int], Callable[[int], None]]:
    """A cursor in a file of a shared folder, replaced whole, so a driver on another machine finds it."""
    files = SharedFolder(spark, folder)
    return lambda: int(files.read(name) or 0), lambda value: files.put(name, str(value)) and None


def settle(changes: DataFrame, quiet: str = "2 seconds", late: str = "30 minutes") -> DataFrame:
    """Changes of a path as bursts that have ended: a session window behind a watermark. ``changes``:
    (path, at, present)."""
    bursts = changes.withWatermark("at", late).groupBy("path", F.session_window("at", quiet).alias("w"))
    return bursts.agg(F.count(F.lit(1)).alias("n"), F.max("present").alias("present"))


def deferred(refs: DataFrame, ttl_ms: int = 30 * 60 * 1000) -> DataFrame:
    """References (path, id, at) held until their path is quiet for ``ttl_ms`` of event time: the
    newest one of each path comes out. State is one row a path."""

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (id_,) = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "id": [id_]})
            return
        newest = max((int(b["id"].max()) for b in batches), default=0)
        held = state.get[0] if state.exists else 0
        state.update((max(newest, held),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + ttl_ms)

    return (
        refs.withWatermark("at", "1 minute")
        .groupBy("path")
        .applyInPandasWithState(hold, "path string, id long", "id long", "append", "EventTimeTimeout")
    )
