"""The audit trail as a stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabarit.session import work_dir

EVENTS = "id long, restriction_id string, event_type string, old_row string, new_row string, actor string, occurred_at timestamp"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The audit events of a folder of Parquet files as a stream; files that come later are read too."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(folder)


LATE = "30 days"  # how long the state knows an event, and how late one still counts


def daily_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """(day, event_type, n), repeated rows once. On a stream an event is known for `late`, and then leaves the state; rows that come later still are dropped."""
    once = events.withWatermark("occurred_at", late) if events.isStreaming else events
    once = once.dropDuplicates(["id", "occurred_at"])
    return once.groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def keep_counts(events: DataFrame, target: str, checkpoint: str, late: str = LATE):
    """A running query that keeps daily_counts of a stream of events in `target`; each batch replaces the counts of the one before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return daily_counts(events, late).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_audit(events: DataFrame, sink: str, checkpoint: str):
    """A running query that appends each micro-batch of events to the trail in `sink`, each batch once: its rows go to a folder named by the batch, which a repeat overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained_counts(spark: SparkSession, d: str) -> DataFrame:
    """daily_counts of the restriction_events of a data folder, counted as a stream until it is drained."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/restriction_events.parquet"
    if os.path.isdir(path):
        events = event_stream(spark, path)
    else:
        events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "restriction_events.parquet").parquet(d)
    keep_counts(events, f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("day string, event_type string, n long").parquet(f"{base}/counts")
