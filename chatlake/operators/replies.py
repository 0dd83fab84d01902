"""Joins along reply links and between neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import time as T
from chatlake.functions.text import preview
from chatlake.operators.running import beside, ranged_running_sum
from chatlake.session import settle


def answered(messages: DataFrame) -> DataFrame:
    """Each reply beside the message it answers: id, from_id, date_unixtime and parent_*; replies to absent messages drop out."""
    replies = messages.where("reply_to_message_id is not null").select("id", "from_id", "from_name", "date_unixtime", F.col("reply_to_message_id").alias("parent_id"))
    parents = messages.select(F.col("id").alias("parent_id"), F.col("from_id").alias("parent_from_id"), F.col("from_name").alias("parent_from_name"), F.col("date_unixtime").alias("parent_time"))
    return replies.join(parents, "parent_id")


def reply_network(messages: DataFrame, limit: int = 100) -> DataFrame:
    """Who answers whom how often, own answers included, with the latest names."""
    pairs = answered(messages).groupBy("from_id", "parent_from_id").agg(F.max_by("from_name", F.when(F.col("from_name").isNotNull(), F.col("id"))).alias("from_name"), F.max_by("parent_from_name", F.when(F.col("parent_from_name").isNotNull(), F.col("parent_id"))).alias("to_name"), F.count("*").alias("count"))
    return pairs.orderBy(F.desc("count"), F.asc_nulls_first("from_id"), F.asc_nulls_first("parent_from_id")).limit(limit).withColumnRenamed("parent_from_id", "to_id")


def reply_seconds(messages: DataFrame) -> DataFrame:
    """seconds of each answer after what it answers, where positive; from_id of the answerer."""
    return answered(messages).select("from_id", (F.col("date_unixtime") - F.col("parent_time")).alias("seconds")).where("seconds > 0")


def mean_reply_time(messages: DataFrame) -> DataFrame:
    """Per sender the mean seconds of answers given within a day."""
    return reply_seconds(messages).where(F.col("seconds") < T.DAY).groupBy("from_id").agg(F.avg("seconds").alias("mean_seconds"), F.count("*").alias("n"))


def with_reply_preview(messages: DataFrame) -> DataFrame:
    """Messages with the name and the first 100 characters of what they answer; null when it is missing."""
    parents = messages.select(F.col("id").alias("parent_id"), F.col("from_name").alias("reply_to_name"), preview(F.col("text_plain"), 100).alias("reply_to_text"))
    return messages.join(parents, messages["reply_to_message_id"] == parents["parent_id"], "left").drop("parent_id")


def partners(messages: DataFrame, user_id: str, sent: bool, limit: int = 10) -> DataFrame:
    """Whom a user answers most (``sent``) or by whom they are answered most; never themselves."""
    pairs = answered(messages).where((F.col("from_id") != F.col("parent_from_id")) & (F.col("from_id" if sent else "parent_from_id") == user_id))
    other = "parent_from_id" if sent else "from_id"
    return pairs.groupBy(F.col(other).alias("user_id")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "user_id").limit(limit)


def conversation_of(messages: DataFrame, first: str, second: str, limit: int = 100) -> DataFrame:
    """The answers two users gave each other, newest first."""
    pair = answered(messages).where(((F.col("from_id") == first) & (F.col("parent_from_id") == second)) | ((F.col("from_id") == second) & (F.col("parent_from_id") == first)))
    return pair.orderBy(F.desc("date_unixtime"), "id").limit(limit)


def entity_messages(messages: DataFrame, entities: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    """Messages with an entity of a kind and its value, newest first."""
    found = entities.where(F.col("type") == kind).select(F.col("message_id").alias("id"), "value").distinct()
    return messages.join(found, "id").orderBy(F.desc("date_unixtime"), "id", "value").limit(limit)


def around(messages: DataFrame, message_id: int, k: int, order: str = "date_unixtime") -> DataFrame:
    """The k messages before and after one message by time, and itself, with position -k..k; equal times are no neighbours."""
    target = messages.where(F.col("id") == message_id)
    rows = messages.transform(beside, target.select(F.col(order).alias("mark")).limit(1))
    before = rows.where(F.col(order) < F.col("mark")).orderBy(F.desc(order), F.desc("id")).limit(k)
    after = rows.where(F.col(order) > F.col("mark")).orderBy(order, "id").limit(k)
    one = Window.partitionBy(F.lit(0))
    return (
        before.withColumn("position", -F.row_number().over(one.orderBy(F.desc(order), F.desc("id"))))
        .unionByName(rows.where(F.col("id") == message_id).withColumn("position", F.lit(0)))
        .unionByName(after.withColumn("position", F.row_number().over(one.orderBy(order, "id"))))
        .drop("mark")
    )


def around_many(messages: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """For each hit (hit_id) the k messages strictly before and after it in time: hit_id, id, position (-k..-1, 1..k).

    All messages are numbered by (date_unixtime, id) once; a hit asks for the k numbers on either side of those that share its
    time, so hits of any number meet the messages by equal numbers. Hits without a message or time have no neighbours.
    """
    timed = messages.select("id", "date_unixtime").where("date_unixtime is not null")
    numbered = settle(ranged_running_sum(timed, [], ["date_unixtime", "id"], {"place": F.lit(1)}))
    asked = settle(hits.select("hit_id").distinct().join(timed.select(F.col("id").alias("hit_id"), "date_unixtime"), "hit_id"))
    same = numbered.join(asked.select("date_unixtime").distinct(), "date_unixtime", "left_semi").groupBy("date_unixtime").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    steps = asked.join(same, "date_unixtime").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(k))))
    wanted = steps.select("hit_id", F.explode(F.array(F.struct((F.col("low") - F.col("n")).alias("place"), (-F.col("n")).alias("position")), F.struct((F.col("high") + F.col("n")).alias("place"), F.col("n").alias("position")))).alias("w"))
    return wanted.select("hit_id", "w.place", "w.position").join(numbered.select("place", "id"), "place").select("hit_id", "id", "position")


def chat_page(messages: DataFrame, entities: DataFrame, condition: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the chat in the order of the date text: messages with reply preview, their entities as a sorted array, total and has_more.

    The page is cut first; previews and entities are looked up for its rows only. Messages without entities have an empty array.
    """
    rows = messages.where(condition) if condition is not None else messages
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy("date", "id").offset(offset).limit(limit)
    parents = messages.select(F.col("id").alias("parent_id"), F.col("from_name").alias("reply_to_name"), preview(F.col("text_plain"), 100).alias("reply_to_text"))
    answered_rows = shown.join(parents, shown["reply_to_message_id"] == parents["parent_id"], "left").drop("parent_id")
    own = entities.join(F.broadcast(shown.select(F.col("id").alias("message_id"))), "message_id", "left_semi")
    packed = own.groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("type", "value"))).alias("entities"))
    full = answered_rows.join(packed, "id", "left").transform(beside, total)
    empty = F.array().cast("array<struct<type:string,value:string>>")
    return full.withColumn("entities", F.coalesce("entities", empty)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))
