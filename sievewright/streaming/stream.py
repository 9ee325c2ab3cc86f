"""Streams of micro-batches through the batch code path."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream."""
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def run_micro_batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int, str], bool | None],
                      name: str | None = None, max_batches: int | None = None) -> int:
    """Feed what is available to `step(batch, epoch, stream id)`; returns the number of batches run.

    The stream id is the one in the checkpoint. A step that returns False has skipped its batch, which does not
    count. With `max_batches` the query is stopped, between batches, after that many (one at least); the checkpoint
    lets a later run go on.
    """
    done, known, stream_id = {"run": 0, "seen": 0}, threading.Event(), []

    def each(batch: DataFrame, epoch: int) -> None:
        known.wait()
        done["run"] += step(batch, epoch, stream_id[0]) is not False
        done["seen"] += 1

    def start(**trigger):
        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger)
        query = (writer.queryName(name) if name else writer).start()
        stream_id[:] = [str(query.id)]
        known.set()
        return query

    if max_batches is None:
        start(availableNow=True).awaitTermination()
        return done["run"]
    while done["run"] < max(max_batches, 1):
        seen = done["seen"]
        # The next trigger lies far ahead, so the query is idle after one batch and can be stopped cleanly.
        query = start(processingTime="1 day")
        while query.isActive and query.status["message"] != "Waiting for next trigger":
            time.sleep(0.05)
        if query.exception() is not None:
            raise query.exception()
        query.stop()
        if done["seen"] == seen:
            break
    return done["run"]
