"""Structured Streaming: windowed event counts with late data, and a response log that grows by new keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.sources.files import append_new


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """start, event_type, n, total per hour; on a stream, rows later than `late` are dropped."""
    if late is not None:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def log_responses(stream: DataFrame, log_path: str, checkpoint: str, keys: tuple[str, ...] = ("record_id",)):
    """Start a query that appends each batch's new rows to the log; a batch that runs again adds nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(log_path, df, list(keys))).start()
