"""Selections over the message table. Every predicate is a plain expression, so it reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import all_of, contains_any_case


def matching(user_id: str | None = None, from_date: int | None = None, to_date: int | None = None, has_links: bool | None = None, has_mentions: bool | None = None, has_media: bool | None = None) -> Column:
    """Conjunction of the given filters; None, 0 and "" mean no filter, flags are tri-state."""
    parts: list[Column] = []
    if user_id:
        parts.append(F.col("from_id") == user_id)
    if from_date:
        parts.append(F.col("date_unixtime") >= from_date)
    if to_date:
        parts.append(F.col("date_unixtime") <= to_date)
    for name, wanted in (("has_links", has_links), ("has_mentions", has_mentions), ("has_media", has_media)):
        if wanted is not None:
            parts.append(F.col(name) == int(wanted))
    return all_of(parts)


def chat_matching(user_id: str | None = None, from_text: str | None = None, to_text: str | None = None, has_media: str | None = None, has_link: str | None = None) -> Column:
    """Filters of the chat view: dates are compared as text; has_media is "1" or "0", has_link only "1"."""
    parts: list[Column] = []
    if user_id:
        parts.append(F.col("from_id") == user_id)
    if from_text:
        parts.append(F.col("date") >= from_text)
    if to_text:
        parts.append(F.col("date") <= to_text)
    if has_media in ("0", "1"):
        parts.append(F.col("has_media") == int(has_media))
    if has_link == "1":
        parts.append(F.col("has_links") == 1)
    return all_of(parts)


def chat_view(messages: DataFrame, condition: Column, found: DataFrame | None = None) -> DataFrame:
    """Messages of the chat view; with ``found`` (id), the hits of a text search, only those."""
    rows = messages.where(condition)
    return rows if found is None else rows.join(found.select("id").distinct(), "id", "left_semi")


def within(start: int, end: int) -> Column:
    """Closed at both ends."""
    return F.col("date_unixtime").between(start, end)


def newest_of_user(messages: DataFrame, user_id: str, limit: int = 100) -> DataFrame:
    """A user's newest messages; ties by id."""
    return messages.where(F.col("from_id") == user_id).orderBy(F.desc("date_unixtime"), "id").limit(limit)


def named_like(rows: DataFrame, column: str, part: str) -> DataFrame:
    return rows.where(contains_any_case(F.col(column), part))


def in_given_order(messages: DataFrame, ids: list[int]) -> DataFrame:
    """The messages with these ids in the order of the list, as column pos from 0; missing ids are left out, repeated ones repeat."""
    wanted = messages.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id long")
    return messages.join(F.broadcast(wanted), "id")


def active_users(messages: DataFrame, min_messages: int, since: int) -> DataFrame:
    """from_id, name, msg_count of the users with enough non-empty texts since a time; the name is the greatest one used."""
    used = messages.where(F.col("from_id").isNotNull() & (F.col("from_id") != "") & (F.col("text_plain") != "") & (F.col("date_unixtime") >= since))
    return used.groupBy("from_id").agg(F.max("from_name").alias("name"), F.count("*").alias("msg_count")).where(F.col("msg_count") >= min_messages)


def sampled(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``n`` rows without replacement, the same for the same seed: the sampling operator."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)
