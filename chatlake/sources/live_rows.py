"""Rows of a live chat client brought into the message and participant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import strip
from chatlake.functions.time import at

LIVE_MESSAGE = """id bigint, text string, date_unixtime bigint, edited_unixtime bigint, reply_to bigint,
    entities array<struct<kind:string,start:int,length:int,url:string>>, sender struct<id:bigint,first_name:string,last_name:string,title:string>,
    forward struct<sender:struct<id:bigint,first_name:string,last_name:string,title:string>,name:string>, photo struct<width:int,height:int>, has_file boolean"""
LIVE_MEMBER = "id bigint, first_name string, last_name string, username string, phone string, is_bot boolean, is_premium boolean, role string, joined bigint, status string, seen bigint"
# The client's kinds of entities and the types they are stored as, and the states of a member.
KINDS = {
    "url": "link", "text_url": "text_link", "mention": "mention", "mention_name": "mention", "bold": "bold", "italic": "italic", "code": "code", "pre": "code",
    "hashtag": "hashtag", "email": "email", "phone": "phone", "bot_command": "bot_command",
}
STATES = ("online", "offline", "recently", "last_week", "last_month")


def _person(who: str, title_too: bool = True) -> tuple[Column, Column]:
    """Name and id of a sender: people have first and last name and ``user`` ids, groups a title and ``channel`` ids."""
    person = F.col(f"{who}.first_name").isNotNull() | F.col(f"{who}.last_name").isNotNull()
    full = strip(F.concat_ws(" ", F.coalesce(f"{who}.first_name", F.lit("")), F.when(F.col(f"{who}.last_name") != "", F.col(f"{who}.last_name"))))
    name = F.when(person, full).when(F.col(f"{who}.title").isNotNull(), F.col(f"{who}.title"))
    kind = F.when(person, "user").when(F.col(f"{who}.title").isNotNull(), "channel")
    return name, F.concat(kind, F.col(f"{who}.id").cast("string"))


def live_messages(rows: DataFrame) -> DataFrame:
    """The message table with entities from live rows (LIVE_MESSAGE); rows without visible text are left out, as are entities of other kinds.

    An entity's text is its stretch of the message, but for a hidden link its address. Unknown senders are empty strings,
    an unknown time is 0; a photo or file makes media. Null fields stay null.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    own = F.transform(F.coalesce("entities", F.array().cast("array<struct<kind:string,start:int,length:int,url:string>>")), lambda e: F.struct(
        F.try_element_at(kinds, e["kind"]).alias("type"), F.when(e["kind"] == "text_url", F.coalesce(e["url"], F.lit(""))).otherwise(F.substring(F.col("text"), e["start"] + 1, e["length"])).alias("value"),
    ))
    entities = F.filter(own, lambda e: e["type"].isNotNull())
    name, sender = _person("sender")
    forward_name, forward_id = _person("forward.sender")
    text = F.col("text")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.where(F.coalesce(strip(text) != "", F.lit(False))).select(
        "id", F.lit("message").alias("type"), F.date_format(at(F.coalesce("date_unixtime", F.lit(0))), iso).alias("date"), F.coalesce("date_unixtime", F.lit(0)).cast("long").alias("date_unixtime"),
        F.coalesce(name, F.lit("")).alias("from_name"), F.coalesce(sender, F.lit("")).alias("from_id"), F.when(F.col("reply_to") != 0, F.col("reply_to")).alias("reply_to_message_id"),
        F.coalesce(forward_name, F.col("forward.name")).alias("forwarded_from"), forward_id.alias("forwarded_from_id"), text.alias("text_plain"), F.length(text).alias("text_length"),
        (F.col("photo").isNotNull() | F.coalesce("has_file", F.lit(False))).cast("int").alias("has_media"), F.col("photo").isNotNull().cast("int").alias("has_photo"),
        F.exists(entities, lambda e: e["type"] == "link").cast("int").alias("has_links"), F.exists(entities, lambda e: e["type"] == "mention").cast("int").alias("has_mentions"),
        F.col("edited_unixtime").isNotNull().cast("int").alias("is_edited"), "edited_unixtime", F.lit(None).cast("long").alias("photo_file_size"),
        F.col("photo.width").alias("photo_width"), F.col("photo.height").alias("photo_height"), F.to_json(F.struct(*[c.split()[0] for c in ("id", "text", "date_unixtime", "sender", "reply_to")])).alias("raw_json"), entities.alias("entities"),
    )


def live_participants(rows: DataFrame, now: int) -> DataFrame:
    """The participant table from live members (LIVE_MEMBER): who is online was seen ``now``; a creator is an admin too; other states are unknown."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("first_name", "last_name", "username", "phone")]
    status = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("unknown")
    seen = F.when(status == "online", F.lit(now)).when(status == "offline", F.col("seen"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.where("id is not null").select(
        F.concat(F.lit("user"), F.col("id").cast("string")).alias("user_id"), *text, flag(F.col("is_bot")).alias("is_bot"), flag(F.col("role").isin("admin", "creator")).alias("is_admin"),
        flag(F.col("role") == "creator").alias("is_creator"), flag(F.col("is_premium")).alias("is_premium"), F.col("joined").alias("join_date"), status.alias("last_status"), seen.cast("long").alias("last_online"),
        F.lit("").alias("about"), F.lit(now).cast("long").alias("updated_at"),
    )
