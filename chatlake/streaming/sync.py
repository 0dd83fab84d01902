"""Incremental sync as Structured Streaming: files or a live source in, exactly one copy of each message out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatlake.functions.time import at
from chatlake.sinks.store import Store
from chatlake.sources.chat_export import parsed

LATE = "36 hours"


def message_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Parsed messages of JSON-lines files as they arrive in a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder).select(F.try_parse_json("value").alias("message")).where("message is not null")
    return parsed(lines)


def once_within(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Each id once within the watermark; ids older than that are settled against the store."""
    timed = stream.withColumn("event_time", at(F.col("date_unixtime"))).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(["id"])


def hourly_counts(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Messages per hour, aligned to the epoch, final once the watermark has passed."""
    timed = stream.withColumn("event_time", at(F.col("date_unixtime"))).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", "1 hour")).agg(F.count("*").alias("count")).select(F.col("window.start").alias("hour"), "count")


def activity_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of each sender while they happen; state is dropped when the watermark passes a session's end."""
    timed = stream.where("from_id <> '' and date_unixtime > 0").withColumn("event_time", at(F.col("date_unixtime"))).withWatermark("event_time", late)
    return timed.groupBy("from_id", F.session_window("event_time", gap)).agg(F.count("*").alias("n_messages")).select("from_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_messages")


def sync(stream: DataFrame, store: Store, checkpoint: str, notify: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Add what a stream has available to a store, batch by batch, then stop; re-delivered messages change nothing.

    After each batch ``notify`` gets the counts, so caches can move to the new version.
    """

    def add(batch: DataFrame, number: int) -> None:
        counts = store.update(batch)
        if notify:
            notify(counts | {"batch": number})

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
