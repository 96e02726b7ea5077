"""Streams of events and documents. Each function takes a stream or a table: over a table it gives the same rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import write_once


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, in the order in which they come."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def late(events: DataFrame, delay: str) -> DataFrame:
    """On a stream, events with a watermark on ts, which event-time state needs; ts is taken in the session's zone."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """start, event_type, events, total of each window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = late(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """user_id, start, end, events of each run of a user's events no further apart than the gap."""
    by = late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def once(events: DataFrame, keys: list[str], delay: str = "2 hours") -> DataFrame:
    """events without those of the same keys; on a stream the keys are kept as long as the watermark says."""
    if events.isStreaming:
        return late(events, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, events, total after each batch: state of one row for each user. A stream only."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(add, "user_id long, events long, total double", "events long, total double", "update", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Adds the stream's rows to the table at path, each key once: a batch that runs again after a failure adds nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, _: write_once(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
