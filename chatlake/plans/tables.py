"""The tables of the chat model as the queries read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.dedup import kept_copies
from chatlake.operators.fulltext import Index, OkapiIndex
from chatlake.operators.hierarchy import hierarchy
from chatlake.operators.ranking import user_ranks
from chatlake.operators.threads import reply_edges, with_messages
from chatlake.session import ensure_checkpoint_dir, read_table
from chatlake.sinks.store import Store

USER = "user200000037"
OTHER = "user200000000"
NOW = 1_454_371_200
"""The moment the time frames of the queries count back from."""


_stores: dict[tuple, Store] = {}


def chat_store(spark: SparkSession, folder: str) -> Store:
    """The store of a data folder: what queries derive from its messages is written once per session into the shared checkpoint folder.

    A store belongs to one state of the messages' files (names, lengths, times); other files get another store.
    """
    ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/messages.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    own = files.getFileStatus(path)
    listed = files.listStatus(path) if own.isDirectory() else [own]
    state = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in listed))
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _stores:
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        _stores[key] = Store(spark, f"{base}/chat-store-{uuid.uuid4().hex[:12]}")
    return _stores[key]


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per message id."""
    return chat_store(spark, folder).ensure("messages", lambda: kept_copies(read_table(spark, folder, "messages")))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The hierarchy of the replies of the kept messages, with the times and senders of those that are there."""
    def build() -> DataFrame:
        rows = messages(spark, folder)
        return with_messages(hierarchy(reply_edges(rows)), rows.select(F.col("id").alias("node_id"), "date_unixtime", "from_id", F.lit(1).alias("present")))

    return chat_store(spark, folder).ensure("nodes", build, ["root_id", "first", "node_id"])


def index(spark: SparkSession, folder: str) -> Index:
    """The full-text index of the kept messages."""
    store = chat_store(spark, folder)
    store.ensure_indexes(lambda: messages(spark, folder), ["postings", "documents", "document_totals"])
    return store.fulltext()


def okapi(spark: SparkSession, folder: str) -> OkapiIndex:
    """The keyword index of the kept messages."""
    store = chat_store(spark, folder)
    store.ensure_indexes(lambda: messages(spark, folder), ["okapi_terms", "okapi_documents", "okapi_totals", "okapi_counts"])
    return store.okapi()


def trigrams(spark: SparkSession, folder: str) -> DataFrame:
    """The trigram postings of the kept messages."""
    store = chat_store(spark, folder)
    store.ensure_indexes(lambda: messages(spark, folder), ["trigrams"])
    return store.read("trigrams")


def count_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered index of message counts."""
    return chat_store(spark, folder).ensure("count_ranks", lambda: user_ranks(messages(spark, folder)), ["from_id"])


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "entities")


def participants(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "participants")


HUB_SQL = "(SELECT reply_to_message_id FROM kept WHERE reply_to_message_id IN (SELECT id FROM kept) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def hub(rows: DataFrame) -> int:
    """The message with the most answers; ties by id."""
    found = rows.where("reply_to_message_id is not null").groupBy(F.col("reply_to_message_id").alias("id")).agg(F.count("*").alias("n"))
    first = found.join(rows.select("id"), "id", "left_semi").orderBy(F.desc("n"), "id").first()
    return first["id"] if first else -1
