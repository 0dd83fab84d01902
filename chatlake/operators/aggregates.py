"""Counts and series over the message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import time as T
from chatlake.functions.text import domain, script_words
from chatlake.operators.running import beside


def _n(name: str = "count") -> Column:
    return F.count("*").alias(name)


def named(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("from_id").isNotNull() & (F.col("from_id") != ""))


def totals(messages: DataFrame) -> DataFrame:
    """One row of totals; distinct users include the empty sender; days_span is whole days between first and last."""
    t = F.col("date_unixtime")
    flags = [F.count_if(F.col(c) == 1).alias(c) for c in ("has_media", "has_photo", "has_links", "has_mentions", "is_edited")]
    return messages.agg(
        _n("total_messages"), F.countDistinct("from_id").alias("total_users"), F.min(t).alias("first_message"), F.max(t).alias("last_message"), F.floor((F.max(t) - F.min(t)) / T.DAY).alias("days_span"), *flags,
        F.count("reply_to_message_id").alias("replies"), F.count("forwarded_from").alias("forwards"),
    )


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(_n())


def overview(messages: DataFrame, start: int, end: int) -> DataFrame:
    """Totals of a time range with means per day; users_per_day is the mean over active days of their distinct users; one decimal, half to even."""
    rows = messages.where(F.col("date_unixtime").between(start, end))
    daily = rows.groupBy(T.day(F.col("date_unixtime")).alias("day")).agg(F.countDistinct("from_id").alias("users"), _n("n"))
    per_day = daily.agg(F.bround(F.avg("users"), 1).alias("users_per_day"))
    t = F.col("date_unixtime")
    whole = rows.agg(_n("total_messages"), F.countDistinct("from_id").alias("active_users"), F.min(t).alias("first_message"), F.max(t).alias("last_message"))
    days = F.greatest(F.lit(1), F.floor((F.col("last_message") - F.col("first_message")) / T.DAY))
    return whole.transform(beside, per_day).select(
        "*", days.alias("days"), F.bround(F.col("total_messages") / days, 1).alias("messages_per_day"), F.bround(F.col("total_messages") / F.greatest(F.lit(1), F.col("active_users")), 1).alias("messages_per_user")
    )


def per_user(messages: DataFrame) -> DataFrame:
    """Per named sender: counts, sums and times; the name is the one of the latest message."""
    t = F.col("date_unixtime")
    return named(messages).groupBy("from_id").agg(
        F.max_by("from_name", F.when(F.col("from_name").isNotNull(), F.struct("date_unixtime", "id"))).alias("name"), _n("message_count"), F.sum("has_links").alias("link_count"), F.sum("has_media").alias("media_count"),
        F.coalesce(F.sum(F.length("text_plain")), F.lit(0)).alias("char_count"), F.min(t).alias("first_message"), F.max(t).alias("last_message"), F.countDistinct(T.day(t)).alias("active_days"),
    )


def top_users(messages: DataFrame, limit: int = 20) -> DataFrame:
    return per_user(messages).orderBy(F.desc("message_count"), "from_id").limit(limit)


def leaderboard(messages: DataFrame, participants: DataFrame, limit: int = 50, offset: int = 0, include_inactive: bool = True) -> DataFrame:
    """Members by message count with their share of all messages and role; members without messages follow, without a rank.

    Roles: creator before admin before bot. Names of the inactive are first and last name, or Unknown. Pages are cut from
    the order (messages desc, from_id). Only the requested page is ranked: its ranks are offset + place.
    """
    role = F.when(F.col("is_creator") == 1, "creator").when(F.col("is_admin") == 1, "admin").when(F.col("is_bot") == 1, "bot")
    people = participants.select(F.col("user_id").alias("from_id"), F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"), role.alias("role"))
    total = messages.agg(_n("all_messages"))
    active = per_user(messages).join(people, "from_id", "left").transform(beside, total).select(
        "from_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "message_count", "link_count", "media_count", "char_count", "active_days",
        F.bround(F.col("message_count") * 100.0 / F.col("all_messages"), 2).alias("percentage"), F.bround(F.col("message_count") / F.greatest(F.lit(1), F.col("active_days")), 1).alias("daily_average"), "role",
    )
    whole = active
    if include_inactive:
        zero, none = F.lit(0).cast("long"), F.lit(0.0)
        silent = people.join(named(messages).select("from_id").distinct(), "from_id", "left_anti")
        name = F.when(F.coalesce("full_name", F.lit("")) == "", "Unknown").otherwise(F.col("full_name"))
        whole = active.unionByName(silent.select("from_id", name.alias("name"), *[zero.alias(c) for c in ("message_count", "link_count", "media_count", "char_count", "active_days")], none.alias("percentage"), none.alias("daily_average"), "role"))
    shown = whole.orderBy(F.desc("message_count"), "from_id").offset(offset).limit(limit)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("message_count"), "from_id")) + offset
    return shown.withColumn("rank", F.when(F.col("message_count") > 0, place).cast("long"))


def user_stats(messages: DataFrame, user_id: str) -> DataFrame:
    """One row: totals of a user with replies sent and received (own replies count)."""
    mine = messages.where(F.col("from_id") == user_id)
    received = messages.where("reply_to_message_id is not null").select(F.col("reply_to_message_id").alias("id")).join(mine.select("id"), "id").agg(_n("replies_received"))
    own = mine.agg(_n("message_count"), F.sum("has_links").alias("links"), F.sum("has_media").alias("media"), F.count("reply_to_message_id").alias("replies_sent"), F.min("date_unixtime").alias("first_message"), F.max("date_unixtime").alias("last_message"))
    return own.transform(beside, received)


def user_profile(messages: DataFrame, user_id: str) -> DataFrame:
    """One row of a user's core numbers; the lists of the profile are operators of their own."""
    t = F.col("date_unixtime")
    mine = messages.where(F.col("from_id") == user_id)
    span = F.greatest(F.lit(1.0), (F.col("last_message") - F.col("first_message")) / T.DAY)
    core = mine.agg(
        _n("total_messages"), F.sum("text_length").alias("total_chars"), F.bround(F.avg("text_length"), 1).alias("avg_length"), F.max("text_length").alias("max_length"), F.sum("has_photo").alias("photos_sent"),
        F.sum("has_mentions").alias("mentions_made"), F.sum("is_edited").alias("edits"), F.count("forwarded_from").alias("forwards_sent"), F.count("reply_to_message_id").alias("replies_sent"),
        F.min(t).alias("first_message"), F.max(t).alias("last_message"), F.countDistinct(T.day(t)).alias("active_days"),
    )
    return core.select(
        "*", F.bround(F.col("total_messages") / F.col("active_days"), 1).alias("daily_average"), F.bround(F.col("total_messages") / span, 1).alias("messages_per_calendar_day"),
        F.bround(F.col("replies_sent") * 100.0 / F.greatest(F.lit(1), F.col("total_messages")), 1).alias("reply_ratio"),
    )


def by_hour(messages: DataFrame, dense: bool = False, skip_unknown: bool = False) -> DataFrame:
    """hour, count; ``dense`` fills all 24, ``skip_unknown`` leaves out time 0."""
    rows = messages.where("date_unixtime <> 0") if skip_unknown else messages
    counts = rows.groupBy(F.hour(T.at(F.col("date_unixtime"))).cast("long").alias("hour")).agg(_n())
    return _filled(counts, "hour", 24) if dense else counts


def by_weekday(messages: DataFrame, dense: bool = False) -> DataFrame:
    """weekday (Sunday 0), count."""
    counts = messages.groupBy(T.sunday_first(F.col("date_unixtime")).cast("long").alias("weekday")).agg(_n())
    return _filled(counts, "weekday", 7) if dense else counts


def _filled(counts: DataFrame, key: str, n: int) -> DataFrame:
    spine = counts.sparkSession.range(n).withColumnRenamed("id", key)
    return spine.join(counts, key, "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def series(messages: DataFrame, unit: str, users: bool = False) -> DataFrame:
    """label, value per hour, day, week or month: messages, or distinct users; sparse."""
    value = F.countDistinct("from_id") if users else F.count("*")
    return messages.groupBy(T.period(F.col("date_unixtime"), unit).alias("label")).agg(value.alias("value"))


def heatmap(messages: DataFrame) -> DataFrame:
    """weekday, hour, count for all 168 cells."""
    t = F.col("date_unixtime")
    counts = messages.groupBy((T.sunday_first(t) * 24 + F.hour(T.at(t))).cast("long").alias("cell")).agg(_n())
    return _filled(counts, "cell", 168).select(F.floor(F.col("cell") / 24).alias("weekday"), (F.col("cell") % 24).alias("hour"), "count")


def top_words(messages: DataFrame, limit: int = 50, min_length: int = 3) -> DataFrame:
    words = messages.select(F.explode(script_words(F.col("text_plain"), min_length)).alias("word"))
    return words.groupBy("word").agg(_n()).orderBy(F.desc("count"), "word").limit(limit)


def top_domains(entities: DataFrame, limit: int = 20) -> DataFrame:
    found = entities.where("type = 'link'").select(domain(F.col("value")).alias("domain")).where("domain <> ''")
    return found.groupBy("domain").agg(_n()).orderBy(F.desc("count"), "domain").limit(limit)


def top_mentions(entities: DataFrame, limit: int = 20) -> DataFrame:
    return entities.where("type = 'mention'").groupBy("value").agg(_n()).orderBy(F.desc("count"), "value").limit(limit)


def forward_sources(messages: DataFrame, limit: int = 20) -> DataFrame:
    """Forwarded messages per source id (a null id is one group) with the source's latest name."""
    rows = messages.where("forwarded_from is not null").groupBy("forwarded_from_id").agg(F.max_by("forwarded_from", F.struct("date_unixtime", "id")).alias("name"), _n())
    return rows.orderBy(F.desc("count"), F.asc_nulls_first("forwarded_from_id")).limit(limit)


def top_links_of(messages: DataFrame, entities: DataFrame, user_id: str, limit: int = 10) -> DataFrame:
    mine = messages.where(F.col("from_id") == user_id).select(F.col("id").alias("message_id"))
    return entities.where("type = 'link'").join(mine, "message_id").groupBy("value").agg(_n()).orderBy(F.desc("count"), "value").limit(limit)


def table_stats(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: messages, users, entities, smallest and largest date text."""
    return messages.agg(_n("messages"), F.countDistinct("from_id").alias("users"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).transform(beside, entities.agg(_n("entities")))


def users_table(messages: DataFrame) -> DataFrame:
    """The user table as first indexed: name of the first message in arrival order, times without the unknown ones."""
    t = F.when(F.col("date_unixtime") > 0, F.col("date_unixtime"))
    return named(messages).groupBy("from_id").agg(F.min_by("from_name", F.when(F.col("from_name").isNotNull(), F.col("delivery_id"))).alias("display_name"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen"), _n("message_count"))


def entities_by_message(entities: DataFrame) -> DataFrame:
    """message_id and its distinct entities as a sorted array; an array holds the entities of one message only."""
    return entities.groupBy("message_id").agg(F.array_sort(F.collect_set(F.struct("type", "value"))).alias("entities"))


def means_of_active(messages: DataFrame) -> DataFrame:
    """One row: mean messages per active user."""
    return named(messages).groupBy("from_id").agg(_n("n")).agg(F.avg("n").alias("mean_messages"))


def top_link_sharers(messages: DataFrame, limit: int = 10) -> DataFrame:
    """Members by shared links over all members, not among the most active only."""
    return per_user(messages).where("link_count > 0").orderBy(F.desc("link_count"), "from_id").limit(limit).select("from_id", "name", "link_count")
