"""Reply graphs and threads on top of the nested-set hierarchy; components of general graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.hierarchy import hierarchy
from chatlake.session import settle


def reply_edges(messages: DataFrame) -> DataFrame:
    """parent_id, child_id of every reply, also to absent messages."""
    return messages.where("reply_to_message_id is not null").select(F.col("reply_to_message_id").alias("parent_id"), F.col("id").alias("child_id"))


def children(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("parent_id") == node).select("child_id").distinct()


def parent(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("child_id") == node).select("parent_id").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's child."""
    return edges.select(F.col("parent_id").alias("node_id")).distinct().join(edges.select(F.col("child_id").alias("node_id")), "node_id", "left_anti")


def _place(nodes: DataFrame, node: int) -> dict | None:
    """Root, depth and range of one node; None if it isn't there. One row comes to the driver, so the tree is then read by its root alone."""
    found = nodes.where(F.col("node_id") == node).select("root_id", "depth", "first", "last").first()
    return found.asDict() if found else None


def _tree(nodes: DataFrame, place: dict | None) -> DataFrame:
    return nodes.where(F.col("root_id") == place["root_id"]) if place else nodes.where(F.lit(False))


def subtree(nodes: DataFrame, node: int) -> DataFrame:
    """A node and its descendants: node_id, depth below the node, place in pre-order and in level order (both from 0).

    Pre-order places are differences of nested-set numbers; level order is (depth, node_id). Nodes on loops have none.
    """
    at = _place(nodes, node)
    if not at or at["first"] is None:
        return nodes.where(F.lit(False)).select("node_id", "depth", F.col("first").alias("place"))
    return _tree(nodes, at).where(F.col("first").between(at["first"], at["last"])).select("node_id", (F.col("depth") - at["depth"]).alias("depth"), (F.col("first") - at["first"]).alias("place"))


def whole_thread(nodes: DataFrame, node: int) -> DataFrame:
    """The tree of the root above a node, as subtree() gives it."""
    return _tree(nodes, _place(nodes, node)).where("depth >= 0").select("node_id", "depth", F.col("first").alias("place"))


def ancestors_of(nodes: DataFrame, node: int) -> DataFrame:
    """node_id and steps (1 is the parent) of the nodes above one."""
    at = _place(nodes, node)
    if not at or at["first"] is None:
        return nodes.where(F.lit(False)).select("node_id", F.col("depth").alias("steps"))
    return _tree(nodes, at).where((F.col("first") < at["first"]) & (F.col("last") >= at["first"])).select("node_id", (F.lit(at["depth"]) - F.col("depth")).alias("steps"))


def line_of(nodes: DataFrame, node: int) -> DataFrame:
    """Ancestors, the node and its descendants, without siblings: node_id, depth in the tree."""
    at = _place(nodes, node)
    if not at or at["first"] is None:
        return nodes.where(F.lit(False)).select("node_id", "depth")
    both = F.col("first").between(at["first"], at["last"]) | ((F.col("first") < at["first"]) & (F.col("last") >= at["first"]))
    return _tree(nodes, at).where(both).select("node_id", "depth")


def context_of(nodes: DataFrame, hits: DataFrame, levels: int = 10) -> DataFrame:
    """For each hit (hit_id) the messages of its thread down to ``levels`` below the root: root_id, node_id, depth, is_thread_context."""
    asked = nodes.join(hits.select(F.col("hit_id").alias("node_id")), "node_id", "left_semi").select("root_id").distinct()
    inside = nodes.where(F.col("depth").between(0, levels)).join(asked, "root_id", "left_semi")
    return inside.join(hits.select(F.col("hit_id").alias("node_id"), F.lit(False).alias("context")).distinct(), "node_id", "left").select("root_id", "node_id", "depth", F.coalesce("context", F.lit(True)).alias("is_thread_context"))


def components(nodes: DataFrame) -> DataFrame:
    """root_id, n_nodes, max_depth of each tree or loop; a child has one parent, so trees and loops are the undirected components."""
    return nodes.groupBy("root_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"))


def with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes with date_unixtime, from_id and present (1) of their message (node_id, ...); null where the message is absent."""
    return nodes.join(messages, "node_id", "left")


def thread_rows(nodes: DataFrame) -> DataFrame:
    """Per thread (its root_id): n_nodes with absent parents, n_messages without, times and participants of the real messages."""
    return nodes.groupBy("root_id").agg(
        F.count("*").alias("n_nodes"), F.count("present").alias("n_messages"), F.max("depth").alias("max_depth"), F.min("date_unixtime").alias("first_message"),
        F.max("date_unixtime").alias("last_message"), F.countDistinct("from_id").alias("n_participants"),
    )


def threads(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """thread_rows of nodes and the messages they stand for."""
    return thread_rows(with_messages(nodes, messages.select(F.col("id").alias("node_id"), "date_unixtime", "from_id", F.lit(1).alias("present"))))


def graph_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes"), F.count("parent_id").alias("n_edges"), F.countDistinct("root_id").alias("n_components"), F.max("depth").alias("max_depth"))


def thread_map(messages: DataFrame, min_length: int = 5) -> DataFrame:
    """id and thread_id of the messages with longer texts: edges count when both ends have them, threads have two messages or more, the rest are orphans (null)."""
    texts = messages.where(F.length("text_plain") > min_length).select("id", "reply_to_message_id")
    ends = texts.select(F.col("id").alias("parent_id"))
    edges = texts.where("reply_to_message_id is not null").select(F.col("reply_to_message_id").alias("parent_id"), F.col("id").alias("child_id")).join(ends, "parent_id", "left_semi")
    placed = hierarchy(edges).select(F.col("node_id").alias("id"), F.col("root_id").alias("thread_id"))
    return texts.select("id").join(placed, "id", "left")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph (a, b) with any number of edges per node.

    Each round every node takes the smallest label around it and then the label of its label, so labels spread over doubling
    distances; the working tables are settled each round and only labels that changed are counted.
    """
    pairs = edges.where("a is not null and b is not null")
    both = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        around = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = label.join(around, "node").select("node", "component", F.least("component", "near").alias("low"))
        lower = settle(lower)
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        label = settle(lower.join(jump, "low", "left").select("node", F.coalesce("lower", "low").alias("next"), "component"))
        if label.where("next <> component").isEmpty():
            return label.select("node", "component")
        label = label.select("node", F.col("next").alias("component"))
