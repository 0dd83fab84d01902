"""Queries of the general training-data operators: hierarchies (p4), repeated deliveries (p5), sessions (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.dedup import kept_copies, resolve_deliveries, seen_ranges
from chatlake.operators.hierarchy import hierarchy, path_pieces, paths
from chatlake.operators.running import beside
from chatlake.operators.sessions import sessionize
from chatlake.session import read_table


def reply_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links an earlier job stored and those the messages name, as one table (parent_id, child_id)."""
    stored = read_table(spark, folder, "reply_graph").select("parent_id", "child_id")
    named = read_table(spark, folder, "messages").select(F.col("reply_to_message_id").alias("parent_id"), F.col("id").alias("child_id"))
    return stored.unionByName(named)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(reply_links(spark, folder)).select("node_id", "root_id", "depth")


def p4_ranges(spark: SparkSession, folder: str) -> DataFrame:
    nodes = hierarchy(reply_links(spark, folder))
    return nodes.select("node_id", "root_id", "depth", "first", "last", (F.col("last") - F.col("first")).alias("n_descendants"))


def p4_in_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """p4_ranges with every round distributed, as a table too large for one task's remainder runs."""
    return hierarchy(reply_links(spark, folder), local_rows=0).select("node_id", "root_id", "depth", "first", "last")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    return paths(hierarchy(reply_links(spark, folder)))


def p4_path_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return path_pieces(hierarchy(reply_links(spark, folder)), 16)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_deliveries(read_table(spark, folder, "messages")).where("not accepted").select("id", "delivery_id")


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_deliveries(read_table(spark, folder, "messages")).where("accepted").select("id", "delivery_id")


def p5_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return seen_ranges(read_table(spark, folder, "messages"))


def p5_later_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The deliveries of the later half of the batches that are accepted against the stored ranges of the earlier half."""
    messages = read_table(spark, folder, "messages")
    marked = beside(messages, messages.agg((F.max("batch_no") / 2).alias("middle")))
    return resolve_deliveries(marked.where("batch_no > middle"), seen=seen_ranges(marked.where("batch_no <= middle"))).where("accepted").select("id", "delivery_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessionize(kept_copies(read_table(spark, folder, "messages").select("id", "delivery_id", "is_edited", "edited_unixtime", "date_unixtime", "from_id")))


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    sessions = p7_found(spark, folder).withColumn("duration", F.col("end_unixtime") - F.col("start_unixtime"))
    return sessions.groupBy("from_id").agg(F.count("*").alias("n_sessions"), F.max("duration").alias("longest_duration"), F.sum("n_messages").cast("long").alias("n_messages"))


QUERIES = {"p4_found": p4_found, "p4_ranges": p4_ranges, "p4_in_rounds": p4_in_rounds, "p4_paths": p4_paths, "p4_path_pieces": p4_path_pieces, "p5_found": p5_found, "p5_kept": p5_kept, "p5_ranges": p5_ranges, "p5_later_batches": p5_later_batches, "p7_found": p7_found, "p7_summary": p7_summary}

_COPIES = """
    SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY coalesce(is_edited = 1, false) DESC,
        coalesce(edited_unixtime, 0) DESC, coalesce(date_unixtime > 0, false) DESC, delivery_id) END AS copy_no FROM messages"""
KEPT_SQL = f"kept AS (SELECT * EXCLUDE (copy_no) FROM ({_COPIES}) WHERE copy_no = 1)"

_LINKS = """links AS (
    SELECT child AS node, min(parent) AS parent FROM (
        SELECT parent_id AS parent, child_id AS child FROM reply_graph UNION ALL SELECT reply_to_message_id, id FROM messages)
    WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY child)"""
_DOWN = """down(node, root, depth, path) AS (
    SELECT DISTINCT parent, parent, 0::BIGINT, [parent] FROM links WHERE parent NOT IN (SELECT node FROM links)
    UNION ALL SELECT l.node, d.root, d.depth + 1, list_append(d.path, l.node) FROM down d JOIN links l ON l.parent = d.node)"""
_LOOPS = """around(node, above) AS (
    SELECT node, parent FROM links WHERE node NOT IN (SELECT node FROM down)
    UNION SELECT a.node, l.parent FROM around a JOIN links l ON l.node = a.above),
loops AS (
    SELECT node, min(above) AS root FROM around WHERE above IN (SELECT node FROM around WHERE node = above) GROUP BY node)"""
_SESSIONS = f"""WITH {KEPT_SQL}, marked AS (
    SELECT from_id, date_unixtime AS moment, CASE WHEN date_unixtime - lag(date_unixtime) OVER w <= 1800 THEN 0 ELSE 1 END AS opens
    FROM kept WHERE from_id <> '' AND date_unixtime > 0 WINDOW w AS (PARTITION BY from_id ORDER BY date_unixtime)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY from_id ORDER BY moment) AS nth FROM marked),
sessions AS (SELECT from_id, min(moment) AS start_unixtime, max(moment) AS end_unixtime, count(*) AS n_messages FROM numbered GROUP BY from_id, nth)"""

SQL = {
    "p4_found": f"WITH RECURSIVE {_LINKS}, {_DOWN}, {_LOOPS} SELECT node AS node_id, root AS root_id, depth FROM down UNION ALL SELECT node, root, -1 FROM loops",
    "p4_ranges": f"""WITH RECURSIVE {_LINKS}, {_DOWN}, {_LOOPS},
        below AS (SELECT above, count(*) AS n FROM (SELECT unnest(path[:-2]) AS above FROM down) GROUP BY above),
        placed AS (SELECT node, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS first FROM down)
        SELECT node AS node_id, root AS root_id, depth, first, first + coalesce(n, 0) AS last, coalesce(n, 0) AS n_descendants
        FROM placed LEFT JOIN below ON above = node UNION ALL SELECT node, root, -1, NULL, NULL, NULL FROM loops""",
    "p4_paths": f"WITH RECURSIVE {_LINKS}, {_DOWN} SELECT node AS node_id, array_to_string(path, '/') AS path FROM down",
    "p4_path_pieces": f"""WITH RECURSIVE {_LINKS}, {_DOWN} SELECT node AS node_id, CASE WHEN depth > 0 THEN path[(depth - 1) // 16 * 16 + 1] END AS head_id,
        array_to_string(CASE WHEN depth > 0 THEN path[(depth - 1) // 16 * 16 + 2 :] ELSE path END, '/') AS path FROM down""",
    "p5_found": f"SELECT id, delivery_id FROM ({_COPIES}) WHERE copy_no > 1",
    "p5_kept": f"SELECT id, delivery_id FROM ({_COPIES}) WHERE copy_no = 1",
    "p5_ranges": """SELECT 0::BIGINT AS producer, id // 65536 AS shard, min(id) AS low, max(id) AS high FROM (
        SELECT id, id - row_number() OVER (PARTITION BY id // 65536 ORDER BY id) AS island FROM (SELECT DISTINCT id FROM messages WHERE id > 0))
        GROUP BY id // 65536, island""",
    "p5_later_batches": f"""WITH half AS (SELECT max(batch_no) / 2 AS middle FROM messages), m AS (SELECT messages.* FROM messages, half WHERE batch_no > middle)
        SELECT id, delivery_id FROM ({_COPIES.replace("FROM messages", "FROM m")}) WHERE copy_no = 1 AND (id IS NULL OR id < 1
        OR id NOT IN (SELECT id FROM messages, half WHERE id IS NOT NULL AND batch_no <= middle))""",
    "p7_found": f"{_SESSIONS} SELECT * FROM sessions",
    "p7_summary": f"""{_SESSIONS} SELECT from_id, count(*) AS n_sessions, max(end_unixtime - start_unixtime) AS longest_duration,
        sum(n_messages)::BIGINT AS n_messages FROM sessions GROUP BY from_id""",
}
SQL["p4_in_rounds"] = f"SELECT node_id, root_id, depth, first, last FROM ({SQL['p4_ranges']})"
