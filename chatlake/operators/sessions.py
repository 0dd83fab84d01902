"""Sessions: a sender's messages parted by pauses, found by pairing the starts with the ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.running import blocked_running_sum
from chatlake.session import settle

GAP_SECONDS = 1800
BLOCK_SECONDS = 86_400


def sessionize(events: DataFrame, key: str = "from_id", time: str = "date_unixtime", gap: int = GAP_SECONDS, block: int = BLOCK_SECONDS) -> DataFrame:
    """Sessions of each ``key``: key, start_unixtime, end_unixtime, n_messages; a pause of more than ``gap`` seconds parts two.

    Events are first counted per (key, second). Each second belongs to a block of time and is shown to the neighbouring
    block when it lies within ``gap`` of the border, so RANGE frames find, per (key, block), the seconds without an event in
    the ``gap`` before (starts) and after (ends). Starts and ends are numbered separately, equal numbers are joined, and the
    difference of the two event ranks gives the count. No window sees more than ``block + 2 * gap`` rows, whatever
    a key's share. Rows with a null or empty key, or without a time above 0, have no session; ``block`` must exceed ``gap``.
    """
    if block <= gap:
        raise ValueError("block must be longer than gap")
    at = F.col(time).cast("long")
    seconds = events.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & (at > 0)).groupBy(F.col(key).alias("who"), at.alias("at")).agg(F.count("*").alias("n"))
    home = F.floor(F.col("at") / block)
    early, late = F.pmod("at", F.lit(block)) < gap, F.pmod("at", F.lit(block)) >= block - gap
    shown = seconds.withColumn("home", home).withColumn("block", F.explode(F.array_compact(F.array("home", F.when(early, F.col("home") - 1), F.when(late, F.col("home") + 1)))))
    line = Window.partitionBy("who", "block").orderBy("at")
    edges = shown.select(
        "who", "at", "n", "home", "block",
        (F.count("*").over(line.rangeBetween(-gap, -1)) == 0).alias("starts"),
        (F.count("*").over(line.rangeBetween(1, gap)) == 0).alias("ends"),
    ).where("block = home").select("who", "at", "n", "block", F.col("starts").cast("long").alias("starts"), F.col("ends").cast("long").alias("ends"))
    ranked = blocked_running_sum(settle(edges), ["who"], "block", ["at"], {"events_before": "n", "starts_before": "starts", "ends_before": "ends"})
    bounds = settle(ranked.where("starts = 1 or ends = 1"))
    first = bounds.where("starts = 1").select("who", F.col("starts_before").alias("nth"), F.col("at").alias("start_unixtime"), F.col("events_before").alias("rank_from"))
    last = bounds.where("ends = 1").select("who", F.col("ends_before").alias("nth"), F.col("at").alias("end_unixtime"), (F.col("events_before") + F.col("n")).alias("rank_to"))
    paired = first.join(last, ["who", "nth"])
    return paired.select(F.col("who").alias(key), "start_unixtime", "end_unixtime", (F.col("rank_to") - F.col("rank_from")).alias("n_messages"))
