"""Chunks of messages for retrieval: sliding windows by count, and threads cut into pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.running import blocked_running_sum
from chatlake.operators.threads import thread_map
from chatlake.session import settle

HOUR = 3600


def _line(prefix: Column | None = None) -> Column:
    name = F.coalesce("from_name", F.lit(""))
    line = F.concat(F.lit("["), name, F.lit(", "), F.substring(F.coalesce("date", F.lit("")), 1, 16), F.lit("] "), F.substring("text_plain", 1, 200))
    return F.concat(prefix, line) if prefix is not None else line


def _chunked(rows: DataFrame, keys: list[str], anchor: Column) -> DataFrame:
    """Gather the few messages of each chunk in order (column nth); chunks are bounded by their size."""
    parts = F.array_sort(F.collect_list(F.struct("nth", "id", "line", "date")))
    packed = rows.groupBy(*keys).agg(parts.alias("parts"))
    return packed.select(
        *keys, F.transform("parts", lambda p: p["id"]).alias("message_ids"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"), anchor.alias("anchor_message_id"),
        F.element_at("parts", 1)["date"].alias("start_date"), F.element_at("parts", -1)["date"].alias("end_date"),
    )


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """nth (from 0) by (date_unixtime, id) per ``keys``, by blocks of an hour."""
    timed = rows.withColumn("hour", F.floor(F.col("date_unixtime") / HOUR))
    return blocked_running_sum(settle(timed), keys, "hour", ["date_unixtime", "id"], {"nth": F.lit(1)}).drop("hour")


def _windows(numbered: DataFrame, size: int, step: int) -> DataFrame:
    """Each message in the windows [w * step, w * step + size) it belongs to."""
    last = F.floor(F.col("nth") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("nth") - size + 1) / step))
    return numbered.where(first <= last).withColumn("window_no", F.explode(F.sequence(first, last)))


def sliding_chunks(messages: DataFrame, size: int = 5, overlap: int = 2, min_length: int = 5) -> DataFrame:
    """Full windows of ``size`` messages in time order, each ``size - overlap`` after the last: window_no, message_ids, text, anchor (the middle), dates."""
    texts = messages.where(F.length("text_plain") > min_length).select("id", "date_unixtime", "date", _line().alias("line"))
    spread = _windows(_numbered(texts, []), size, size - overlap)
    chunks = _chunked(spread, ["window_no"], F.element_at("parts", size // 2 + 1)["id"])
    return chunks.where(F.size("message_ids") == size)


def thread_chunks(messages: DataFrame, longest: int = 10, size: int = 5, overlap: int = 2, min_length: int = 5) -> DataFrame:
    """Threads cut every ``longest`` messages, and windows over the messages without thread: chunk_type, thread_id, chunk_no, message_ids, text, anchor, dates.

    Answers get an arrow before their line; the anchor is the first message of a thread's piece and the middle of a window.
    Fewer orphans than a window make one short window.
    """
    texts = messages.where(F.length("text_plain") > min_length).select("id", "date_unixtime", "date", "from_name", "text_plain", "reply_to_message_id")
    placed = settle(texts.join(thread_map(messages, min_length), "id"))
    arrow = F.when(F.col("reply_to_message_id").isNotNull(), F.lit("↳ ")).otherwise(F.lit(""))
    threaded = _numbered(placed.where("thread_id is not null").select("id", "date_unixtime", "date", "thread_id", _line(arrow).alias("line")), ["thread_id"])
    pieces = _chunked(threaded.withColumn("chunk_no", F.floor(F.col("nth") / longest)), ["thread_id", "chunk_no"], F.element_at("parts", 1)["id"])
    orphans = settle(_numbered(placed.where("thread_id is null").select("id", "date_unixtime", "date", _line().alias("line")), []))
    few = orphans.count() < size
    spread = orphans.withColumn("window_no", F.lit(0).cast("long")) if few else _windows(orphans, size, size - overlap)
    middle = F.element_at("parts", (F.size("parts") / 2).cast("int") + 1)["id"]
    windows = _chunked(spread, ["window_no"], middle)
    windows = windows if few else windows.where(F.size("message_ids") == size)
    return pieces.select(F.lit("thread").alias("chunk_type"), "thread_id", "chunk_no", "message_ids", "text", "anchor_message_id", "start_date", "end_date").unionByName(
        windows.select(F.lit("window").alias("chunk_type"), F.lit(None).cast("long").alias("thread_id"), F.col("window_no").alias("chunk_no"), "message_ids", "text", "anchor_message_id", "start_date", "end_date")
    )


def read_chunks(store: DataFrame) -> DataFrame:
    """A stored chunk table with message_ids as an array and chunk_type filled (window when the column or value is missing)."""
    kind = F.coalesce("chunk_type", F.lit("window")) if "chunk_type" in store.columns else F.lit("window")
    return store.withColumn("chunk_type", kind).withColumn("message_ids", F.from_json("message_ids", "array<bigint>"))
