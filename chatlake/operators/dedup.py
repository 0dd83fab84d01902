"""Exactly one copy of each message that was delivered at least once, and membership tests between deliveries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 16
"""A producer's sequence is cut into shards of 2**SHARD_BITS numbers, so one producer is spread over many tasks."""
BUFFER_ROWS = 200_000
"""Rows a task holds while it discards the copies that already lose within its own input."""


def preference() -> list[Column]:
    """Order of the copies of one id: edited first, the latest edit first, known time first, first delivery first."""
    return [
        F.when(F.col("is_edited") == 1, 0).otherwise(1),
        F.coalesce(F.col("edited_unixtime"), F.lit(0)).desc(),
        F.when(F.col("date_unixtime") > 0, 0).otherwise(1),
        F.col("delivery_id").asc_nulls_last(),
    ]


def kept_copies(deliveries: DataFrame) -> DataFrame:
    """The kept row of each id, all columns; rows with a null id are no copies of one another and all stay.

    ``row_number() = 1`` plans a group limit before the exchange, so a hot id sends one row per task. Rows equal in every
    preference (repeated delivery ids) are settled arbitrarily, one stays. An empty table gives an empty result.
    """
    copies = Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("delivery_id"))).orderBy(*preference())
    return deliveries.withColumn("__copy", F.row_number().over(copies)).where("__copy = 1").drop("__copy")


class SeenRanges:
    """The numbers seen of one producer as disjoint closed ranges, sorted; neighbouring ranges merge."""

    def __init__(self) -> None:
        self.low = np.empty(0, np.int64)
        self.high = np.empty(0, np.int64)

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.low, numbers, "right") - 1
        hit = at >= 0
        hit[hit] = numbers[hit] <= self.high[at[hit]]
        return hit

    def add(self, numbers: np.ndarray) -> None:
        """Add sorted numbers, repeated or not."""
        if len(numbers):
            cut = np.flatnonzero(np.diff(numbers) > 1)
            self.add_ranges(numbers[np.r_[0, cut + 1]], numbers[np.r_[cut, len(numbers) - 1]])

    def add_ranges(self, low: np.ndarray, high: np.ndarray) -> None:
        """Add closed ranges in any order, overlapping or not; touching ones merge."""
        low, high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        first = np.r_[True, low[1:] > high[:-1] + 1]
        self.low, self.high = low[first], high[np.r_[np.flatnonzero(first)[1:] - 1, len(high) - 1]]


def _best_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark the rows that lose against another copy of their id within this task's input."""

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["producer", "number", "known", "rank_edit", "rank_time", "rank_date", "delivery_id"], kind="stable", ignore_index=True)
        same = part.known & part.producer.eq(part.producer.shift()) & part.number.eq(part.number.shift()) & part.known.shift(fill_value=False)
        return part.assign(lost=same)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BUFFER_ROWS:
            yield marked(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if rows:
        yield marked(pd.concat(held, ignore_index=True))


def _accept_uncovered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accept each number that its shard's ranges don't cover yet; malformed identifiers are looked up by their exact key.

    The rows of a shard come together: ranges seen before first, then its deliveries in the order of preference, whatever
    their numbers, so the first copy that asks for a number is the best one and closes the number for the others. The rows
    of a malformed identifier come one after the other, the best one first.
    """
    shard, seen, last_key = None, SeenRanges(), None
    for batch in batches:
        accepted = np.zeros(len(batch), bool)
        candidate = ~batch.lost.to_numpy()
        known, sound, stored = batch.known.to_numpy(), batch.sound.to_numpy(), batch.stored.to_numpy()
        accepted[candidate & ~known] = True
        for at in np.flatnonzero(candidate & known & ~sound):
            key = (batch.producer.iat[at], batch.number.iat[at])
            accepted[at] = key != last_key
            last_key = key
        rows = np.flatnonzero(candidate & known & sound)
        producers, places = batch.producer.to_numpy()[rows], batch.place.to_numpy()[rows]
        numbers, highs, stored = batch.number.to_numpy()[rows], batch.high.to_numpy()[rows], stored[rows]
        for begin, end in _runs(producers, places):
            if (producers[begin], places[begin]) != shard:
                shard, seen = (producers[begin], places[begin]), SeenRanges()
            split = begin + int(stored[begin:end].sum())
            if split > begin:
                seen.add_ranges(numbers[begin:split], highs[begin:split])
            if split < end:
                part = numbers[split:end]
                wanted, at = np.unique(part, return_index=True)
                accepted[rows[split:end][at[~seen.covers(wanted)]]] = True
                seen.add(wanted)
        kept = ~batch.stored.to_numpy()
        yield pd.DataFrame({"number": batch.number[kept], "known": known[kept], "delivery_id": batch.delivery_id[kept], "numbered": batch.numbered[kept], "accepted": accepted[kept]})


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys[0]):
        return []
    cut = np.flatnonzero(np.any([key[1:] != key[:-1] for key in keys], axis=0)) + 1
    return list(zip(np.r_[0, cut].tolist(), np.r_[cut, len(keys[0])].tolist(), strict=True))


def resolve_deliveries(deliveries: DataFrame, producer: Column | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Say of each delivered row whether it is the kept copy: columns id, delivery_id, accepted.

    Identifiers are numbers of a producer's sequence; without ``producer`` all come from one counter. Each task first marks
    the copies that lose within its own input; what is left goes to the shard of its number, where the numbers seen are kept
    as disjoint ranges and each uncovered number is accepted once, in the order of preference. ``seen`` has the ranges of
    earlier loads (as ``seen_ranges`` gives them): numbers they cover are not accepted again. Losers travel by their delivery
    id, so a hot id isn't gathered anywhere. Numbers below 1 are malformed and settled by exact key; rows without id are all
    accepted.
    """
    source = deliveries.select(
        (F.lit(0) if producer is None else producer).cast("long").alias("producer"),
        F.coalesce(F.col("id"), F.lit(0)).cast("long").alias("number"),
        F.col("id").isNotNull().alias("known"),
        F.coalesce(F.col("id") > 0, F.lit(False)).alias("sound"),
        F.coalesce(F.when(F.col("is_edited") == 1, 0), F.lit(1)).cast("byte").alias("rank_edit"),
        (-F.coalesce(F.col("edited_unixtime"), F.lit(0))).cast("long").alias("rank_time"),
        F.coalesce(F.when(F.col("date_unixtime") > 0, 0), F.lit(1)).cast("byte").alias("rank_date"),
        F.col("delivery_id").isNotNull().alias("numbered"),
        F.coalesce(F.col("delivery_id"), F.lit(2**63 - 1)).cast("long").alias("delivery_id"),
    )
    columns = ", ".join(f"{c} {kind}" for c, kind in source.dtypes)
    thinned = source.mapInPandas(_best_of_task, f"{columns}, lost boolean")
    placed = thinned.withColumns({"place": F.when(F.col("sound"), F.shiftright("number", SHARD_BITS)).otherwise(F.col("number")), "high": F.col("number"), "stored": F.lit(False)})
    if seen is not None:
        none = {c: F.lit(0).cast(kind) for c, kind in source.dtypes if c not in ("producer", "number", "known", "sound")}
        ranges = seen.select("producer", F.col("low").alias("number"), F.lit(True).alias("known"), F.lit(True).alias("sound"), *[v.alias(c) for c, v in none.items()], F.lit(False).alias("lost"), F.col("shard").alias("place"), "high", F.lit(True).alias("stored"))
        placed = placed.unionByName(ranges)
    routed = placed.repartition(F.when(F.col("lost") | ~F.col("known"), F.xxhash64("delivery_id")).otherwise(F.xxhash64("producer", "place")))
    ordered = routed.sortWithinPartitions("lost", "sound", "producer", "place", F.desc("stored"), "rank_edit", "rank_time", "rank_date", "delivery_id")
    settled = ordered.mapInPandas(_accept_uncovered, "number long, known boolean, delivery_id long, numbered boolean, accepted boolean")
    return settled.select(F.when(F.col("known"), F.col("number")).alias("id"), F.when(F.col("numbered"), F.col("delivery_id")).alias("delivery_id"), "accepted")


def seen_ranges(ids: DataFrame, producer: str | None = None) -> DataFrame:
    """The positive ids of a table as disjoint ranges: producer, shard, low, high. Ranges end at shard borders, so each shard's window is bounded."""
    numbers = ids.where(F.col("id") > 0).select((F.col(producer) if producer else F.lit(0)).cast("long").alias("producer"), F.col("id").cast("long").alias("number")).distinct()
    numbers = numbers.withColumn("shard", F.shiftright("number", SHARD_BITS))
    at = Window.partitionBy("producer", "shard").orderBy("number")
    islands = numbers.withColumn("island", F.col("number") - F.row_number().over(at))
    return islands.groupBy("producer", "shard", "island").agg(F.min("number").alias("low"), F.max("number").alias("high")).drop("island")


def not_yet_seen(deliveries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows whose id no stored range covers (the incremental form); malformed and null ids pass and are settled by key."""
    asked = deliveries.withColumn("__shard", F.shiftright(F.col("id").cast("long"), SHARD_BITS))
    condition = (asked["__shard"] == ranges["shard"]) & asked["id"].between(ranges["low"], ranges["high"]) & (asked["id"] > 0)
    return asked.join(ranges, condition, "left_anti").drop("__shard")


def first_copies(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per ``keys`` in ``order``; null keys count as equal. Exact, unlike a Bloom filter."""
    ranked = rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__copy = 1").drop("__copy")


def unseen(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` lacks: the existing row wins."""
    return new.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")
