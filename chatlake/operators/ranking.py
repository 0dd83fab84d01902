"""Ranks of members by message count, and the ordered index of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def message_counts(messages: DataFrame, named_only: bool = True) -> DataFrame:
    """from_id, n; ``named_only`` leaves out null and empty senders."""
    rows = messages.where(F.col("from_id").isNotNull() & (F.col("from_id") != "")) if named_only else messages
    return rows.groupBy("from_id").agg(F.count("*").alias("n"))


def count_index(messages: DataFrame) -> DataFrame:
    """The distinct message counts in order, as rank_from_top and rank_from_bottom (1-based), with the last member who has each and the number of counts.

    Members with one count collapse into one entry. The index has as many rows as there are distinct counts, which grows with
    the square root of the messages, so its windows are small.
    """
    entries = message_counts(messages).groupBy("n").agg(F.max("from_id").alias("from_id"), F.count("*").alias("n_members"))
    whole = Window.partitionBy(F.lit(0))
    return entries.select("n", "from_id", "n_members", F.row_number().over(whole.orderBy(F.desc("n"))).alias("rank_from_top"), F.row_number().over(whole.orderBy("n")).alias("rank_from_bottom"), F.count("*").over(whole).alias("n_counts"))


def user_ranks(messages: DataFrame) -> DataFrame:
    """Each member's dense rank by message count, the number of distinct counts, and two percentiles.

    percentile = (n_counts - rank from bottom) / n_counts * 100 as the analyzer has it; percentile_above = share of counts not
    above, one decimal, as the service has it.
    """
    index = count_index(messages).select("n", "rank_from_top", "rank_from_bottom", "n_counts")
    return message_counts(messages).join(index, "n").select(
        "from_id", F.col("n").alias("message_count"), F.col("rank_from_top").cast("long").alias("rank"), F.col("n_counts").alias("total_users"),
        ((F.col("n_counts") - F.col("rank_from_bottom")) / F.col("n_counts") * 100).alias("percentile"),
        F.round(100 * (F.col("n_counts") - F.col("rank_from_top") + 1) / F.col("n_counts"), 1).alias("percentile_above"),
    )


def user_by_rank(messages: DataFrame, rank: int) -> DataFrame:
    """The member at a dense rank from the top; of several with that count the greatest id; no row if out of range."""
    return count_index(messages).where(F.col("rank_from_top") == rank).select("from_id", F.col("n").alias("message_count"))


def competition_ranks(messages: DataFrame) -> DataFrame:
    """from_id, n, rank = 1 + number of senders (also null and empty ones) with more messages; ranks come from the table of distinct counts."""
    counts = message_counts(messages, named_only=False)
    by_n = counts.groupBy("n").agg(F.count("*").alias("members"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_n.select("n", (F.coalesce(F.sum("members").over(above), F.lit(0)) + 1).alias("rank"))
    return counts.join(ranks, "n").select("from_id", "n", "rank")


def select_kth(pairs: DataFrame, k: int) -> DataFrame:
    """Value of the k-th smallest distinct key (from 1) of (key, value, seq); a repeated key keeps its latest value."""
    latest = pairs.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return latest.orderBy("key").offset(k - 1).limit(1)


def rank_of(pairs: DataFrame, key: int) -> DataFrame:
    """One row: 1-based rank of a key among the distinct keys; of an absent key the number of smaller keys."""
    keys = pairs.select("key").distinct()
    return keys.agg((F.count_if(F.col("key") < key) + F.max(F.when(F.col("key") == key, 1).otherwise(0))).cast("long").alias("rank"))


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.max_by("value", "seq").alias("value")).orderBy("key")


def top_in_range(messages: DataFrame, start: int, end: int, field: str, k: int) -> DataFrame:
    """The k messages of a closed time range with the largest field; ties by id."""
    return messages.where(F.col("date_unixtime").between(start, end)).orderBy(F.desc(field), "id").limit(k)


def time_rank(messages: DataFrame, field: str, key: int) -> DataFrame:
    """One row: rank, the number of distinct values of a field up to a key (1-based rank of a value that is there)."""
    return rank_of(messages.where(F.col(field).isNotNull()).select(F.col(field).alias("key")), key)


def record_at_rank(messages: DataFrame, field: str, k: int) -> DataFrame:
    """The message whose value of a field is the k-th smallest distinct one; of several the one with the greatest id."""
    rows = messages.where(F.col(field).isNotNull())
    value = rows.select(field).distinct().orderBy(field).offset(k - 1).limit(1)
    return rows.join(F.broadcast(value), field, "left_semi").orderBy(F.desc("id")).limit(1)
