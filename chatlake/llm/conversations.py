"""Conversations rebuilt from message rows: reply graphs sorted topologically, broken ones dropped."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.dedup import kept_copies
from chatlake.operators.hierarchy import LOCAL_ROWS, in_one_task, places
from chatlake.operators.running import ranged_running_sum
from chatlake.session import settle

_NONE = np.iinfo(np.int64).min
QUEUE_ROWS = 500_000
"""Messages of one queue: a contiguous range of ids, in which most answers stand near what they answer."""


def visible(text: Column) -> Column:
    """At least one character that is neither white space nor a control or format character; null text has none."""
    return F.coalesce(text.rlike(r"[^\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


def _queued(nodes: np.ndarray, parents: np.ndarray, dates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kahn's algorithm over the sorted ids of one range: for each message the number of its topmost message in the range, and its wave below it.

    A message without a parent in the range is ready at once; each emitted message frees its answers; of the ready ones the
    earliest (then smallest id) is emitted next. What is left over, -1, leads into a loop within the range.
    """
    at = np.minimum(np.searchsorted(nodes, parents), len(nodes) - 1)
    at = np.where(nodes[at] == parents, at, -1)
    answers = np.argsort(at, kind="stable")
    begins, ends = (np.searchsorted(at[answers], np.arange(len(nodes)), side).tolist() for side in ("left", "right"))
    top, wave = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
    ready = np.flatnonzero(at < 0)
    top[ready] = ready
    alone = ready[np.array(begins)[ready] == np.array(ends)[ready]]
    ready = np.setdiff1d(ready, alone, assume_unique=True)
    top_of, wave_of, answers = top.tolist(), wave.tolist(), answers.tolist()
    dates, ids = dates.tolist(), nodes.tolist()
    queue = [(dates[i], ids[i], i) for i in ready.tolist()]
    heapify(queue)
    while queue:
        _, _, i = heappop(queue)
        for j in answers[begins[i] : ends[i]]:
            top_of[j], wave_of[j] = top_of[i], wave_of[i] + 1
            if begins[j] < ends[j]:
                heappush(queue, (dates[j], ids[j], j))
    return np.array(top_of, np.int64), np.array(wave_of, np.int64)


def _in_queues(queue_rows: int):
    """Cut the sorted rows of a task into ranges of about ``queue_rows`` and run the queue over each."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        nodes, dates = part.column("node").to_numpy(), part.column("date").to_numpy()
        parents = part.column("parent").fill_null(_NONE).to_numpy()
        top, wave = _queued(nodes, parents, dates)
        kept = np.flatnonzero(top >= 0)
        ahead = parents[top[kept]]
        columns = [pa.array(nodes[kept]), part.column("flaw").take(pa.array(kept)), pa.array(nodes[top[kept]]), pa.array(wave[kept]), pa.array(ahead, mask=ahead == _NONE)]
        return pa.RecordBatch.from_arrays(columns, ["node", "flaw", "top", "wave", "ahead"])

    def queues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, queue_rows):
                held.append(batch.slice(begin, queue_rows))
                rows += held[-1].num_rows
                if rows >= queue_rows:
                    yield run(held)
                    held, rows = [], 0
        if held:
            yield run(held)

    return queues


def _links_locally(part: pd.DataFrame) -> pd.DataFrame:
    """The remaining links of a counted remainder, by doubling on arrays; what leads into a loop is left out."""
    nodes, wave = part.node.to_numpy(), part.wave.to_numpy().copy()
    ahead = places(nodes, part.ahead.astype("Int64"))
    root, waiting = part.root.astype("Int64").to_numpy(np.int64, na_value=_NONE), -1
    while True:
        has = ahead >= 0
        up = ahead[has]
        root[has] = np.where(ahead[up] < 0, root[up], root[has])
        wave[has] += wave[up]
        ahead = np.where(has, ahead[ahead], -1)
        left = int((ahead >= 0).sum())
        if left in (0, waiting):
            break
        waiting = left
    keep = (ahead < 0) & (root != _NONE)
    return pd.DataFrame({"node": nodes[keep], "root": root[keep], "wave": wave[keep]})


def _joined_ranges(live: DataFrame, local_rows: int) -> DataFrame:
    """node, root, wave from settled ``live`` (node, ahead, root, wave): links between ranges, followed by doubling.

    After round k all nodes within 2**k links of a root are emitted. Emitted nodes stay only while a waiting one may ask for
    them. When a round emits nothing, what is left over leads into a loop and is dropped, as is what leads nowhere.
    """
    emitted: list[DataFrame] = []
    waiting = -1
    while True:
        left = live.where("ahead is not null").count()
        if left in (0, waiting) or left <= local_rows:
            if left in (0, waiting):
                rest = live.where("ahead is null").drop("ahead")
            else:
                rest = in_one_task(live.selectExpr("node", "cast(ahead as string) as ahead", "cast(root as string) as root", "wave"), _links_locally, "node long, root long, wave long")
            emitted.append(rest.select("node", "root", "wave"))
            return reduce(DataFrame.unionByName, emitted).where("root is not null")
        waiting = left
        asked = live.where("ahead is not null").select(F.col("ahead").alias("node")).distinct().withColumn("asked", F.lit(True))
        target = live.select(F.col("node").alias("ahead"), F.col("ahead").alias("further"), F.col("root").alias("its_root"), F.col("wave").alias("its_wave"))
        moved = live.join(asked, "node", "left").join(target, "ahead", "left").select(
            "node", F.col("further").alias("ahead"), F.coalesce("root", "its_root").alias("root"), (F.col("wave") + F.coalesce("its_wave", F.lit(0))).alias("wave"),
            (F.col("further").isNull() & F.col("asked").isNull()).alias("final"),
        )
        live = settle(moved)
        emitted.append(live.where("final").select("node", "root", "wave"))
        live = live.where("not final").drop("final")


def kahn_waves(nodes: DataFrame, queue_rows: int = QUEUE_ROWS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Kahn's algorithm over reply graphs: ``nodes`` (node, parent, date, flaw; null parent for roots) to (node, root, wave, flaw).

    The messages are cut into ranges of ids, and each range runs its own queue, which emits a message once the one it answers
    is emitted, earliest first. Messages whose parent stands in another range are emitted as tops of their part; the links
    between ranges, few as most answers stand near, are then followed by doubling. What leads into a loop, within a range or
    across, is never emitted, and what leads to a parent that isn't among the nodes is dropped.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(nodes.select("node", "parent", "date", "flaw").repartitionByRange(n, "node").sortWithinPartitions("node").mapInArrow(_in_queues(queue_rows), "node long, flaw boolean, top long, wave long, ahead long"))
    entries = rows.where("node = top and ahead is not null").select("node", "ahead")
    target = rows.select(F.col("node").alias("ahead"), F.col("top").alias("their_top"), "wave", F.col("ahead").isNull().alias("rooted"))
    live = settle(entries.join(target, "ahead").select("node", F.when(~F.col("rooted"), F.col("their_top")).alias("ahead"), F.when(F.col("rooted"), F.col("their_top")).alias("root"), (F.col("wave") + 1).alias("wave")))
    tops = _joined_ranges(live, local_rows).select(F.col("node").alias("top"), "root", F.col("wave").alias("above"))
    near = rows.where("ahead is null").select("node", F.col("top").alias("root"), "wave", "flaw")
    far = rows.where("ahead is not null").join(tops, "top").select("node", "root", (F.col("wave") + F.col("above")).alias("wave"), "flaw")
    return near.unionByName(far)


def conversations(messages: DataFrame, queue_rows: int = QUEUE_ROWS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The turns of complete conversations: root_id, turn_no, message_id, role, from_id, date_unixtime, wave.

    Of each id the kept copy counts. A conversation is a message that answers none, with all that answer it directly or
    through others. It is dropped if it has one message, a member without sender or time, a member older than the message it
    answers, a root without visible text, or no visible answer from another sender. Roles are opener (the root's sender) and
    answerer. Members with visible text are numbered by (date_unixtime, id), a topological order since dates never fall along
    a link. Rows without id are no members; a null time counts as unknown. An empty table gives no rows. ``queue_rows`` is the
    size of a queue's range of ids; at most ``local_rows`` links between ranges, once counted, are followed in one task.
    """
    columns = ["id", "delivery_id", "is_edited", "edited_unixtime", "date_unixtime", "from_id", "reply_to_message_id", "text_plain"]
    kept = kept_copies(messages.select(*columns).where("id is not null"))
    known = settle(kept.select("id", F.col("reply_to_message_id").alias("parent"), F.coalesce("date_unixtime", F.lit(0)).alias("date"), F.coalesce("from_id", F.lit("")).alias("sender"), visible(F.col("text_plain")).alias("shown")))
    nameless = (F.col("date") == 0) | (F.col("sender") == "")
    above = known.select(F.col("id").alias("parent"), F.col("date").alias("parent_date"), F.col("parent").isNull().alias("below_root"))
    links = settle(known.where("parent is not null").join(above, "parent").select(F.col("id").alias("node"), "parent", "date", (nameless | (F.col("date") < F.col("parent_date"))).alias("flaw"), "below_root", "parent_date"))
    roots = links.where("below_root").groupBy(F.col("parent").alias("node")).agg(F.max("parent_date").alias("date")).select("node", F.lit(None).cast("long").alias("parent"), "date", F.lit(False).alias("flaw"))
    waves = kahn_waves(links.select("node", "parent", "date", "flaw").unionByName(roots), queue_rows, local_rows)
    members = settle(waves.join(known.select(F.col("id").alias("node"), "date", "sender", "shown"), "node").withColumn("flaw", F.col("flaw") | nameless))
    at_root = F.col("node") == F.col("root")
    verdict = members.groupBy("root").agg(
        F.count("*").alias("n"), F.max("flaw").alias("flaw"), F.max(F.when(at_root, F.col("sender"))).alias("opener"), F.max(at_root & F.col("shown")).alias("opened"),
        F.min(F.when(F.col("shown"), F.col("sender"))).alias("low"), F.max(F.when(F.col("shown"), F.col("sender"))).alias("high"),
    )
    whole = verdict.where("n > 1 and not flaw and opened and (low <> opener or high <> opener)").select("root", "opener")
    turns = members.where("shown").join(whole, "root")
    numbered = ranged_running_sum(turns, ["root"], ["date", "node"], {"before": F.lit(1)})
    return numbered.select(
        F.col("root").alias("root_id"), (F.col("before") + 1).cast("long").alias("turn_no"), F.col("node").alias("message_id"),
        F.when(F.col("sender") == F.col("opener"), "opener").otherwise("answerer").alias("role"), F.col("sender").alias("from_id"), F.col("date").alias("date_unixtime"), "wave",
    )
