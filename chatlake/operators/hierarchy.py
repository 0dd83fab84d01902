"""Parent-child links of unknown depth: sizes upward, nested-set ranges downward, loops as what stays unprocessed.

All passes double their reach each round: after round k a node knows about 2**k levels, so a chain of a million links takes
twenty rounds. Nodes leave the working set as soon as neither they nor anything below them can still change, and once a
counted remainder has at most LOCAL_ROWS rows, the remaining rounds run in one task, by the same doubling on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.running import beside, blocked_running_sum
from chatlake.session import settle

SIBLING_BLOCK = 65_536
"""Siblings are summed in blocks of this many ids, so a parent of any fan-out is spread over tasks."""

LOCAL_ROWS = 100_000
"""Waiting nodes that one task may finish: a few megabytes."""

RANGE_BLOCK = 256
"""Preorder places of a block in which asked ranges meet the nodes below them."""

PATH_PIECE = 64
"""Steps of a piece of a path."""


@dataclass
class Upward:
    """sizes: node, parent, size of the nodes that hang from a root. unprocessed: node, parent, reach of those on or below a loop."""

    sizes: DataFrame
    unprocessed: DataFrame | None


def distinct_links(links: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """One row (node, parent) per child. Links with a null end are dropped; a child with several parents keeps the smallest."""
    ends = links.select(F.col(child).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"))
    return ends.where("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent"))


def conflicting_links(links: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """node, parent of the links that ``distinct_links`` leaves out: those of a child with several parents to any but the smallest."""
    ends = links.select(F.col(child).cast("long").alias("node"), F.col(parent).cast("long").alias("parent")).where("node is not null and parent is not null").distinct()
    several = ends.groupBy("node").agg(F.min("parent").alias("kept"), F.count("*").alias("n")).where("n > 1").select("node", "kept")
    return ends.join(several, "node").where("parent <> kept").select("node", "parent")


def with_roots(links: DataFrame) -> DataFrame:
    """The links and, with a null parent, each parent that is nobody's child."""
    tops = links.select(F.col("parent").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
    return links.unionByName(tops.withColumn("parent", F.lit(None).cast("long")))


def _union(parts: list[DataFrame]) -> DataFrame:
    """The rounds' results in as many partitions as a shuffle has, not in a few hundred small ones."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.coalesce(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_one_task(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on all rows at once; only for row numbers that were counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield work(pd.concat(parts, ignore_index=True))

    return rows.coalesce(1).mapInPandas(run, schema)


def places(nodes: np.ndarray, wanted: pd.Series) -> np.ndarray:
    """Index of each wanted id among the nodes; -1 for null and for ids that aren't there."""
    order = np.argsort(nodes, kind="stable")
    values = wanted.fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy()
    at = np.minimum(np.searchsorted(nodes[order], values), max(len(nodes) - 1, 0))
    return np.where((nodes[order][at] == values) & wanted.notna().to_numpy(), order[at], -1)


def _exact(column: str) -> str:
    """A nullable id as text, since pandas would turn it into a float."""
    return f"cast({column} as string) as {column}"


def _ids(column: pd.Series) -> pd.Series:
    return column.astype("Int64")


def _sizes_locally(part: pd.DataFrame) -> pd.DataFrame:
    nodes, size = part.node.to_numpy(), part["size"].to_numpy().copy()
    reach, waiting = places(nodes, _ids(part.reach)), -1
    while True:
        below = reach >= 0
        gain = np.zeros_like(size)
        np.add.at(gain, reach[below], size[below])
        reach = np.where(below, reach[reach], -1)
        size += gain
        left = int((reach >= 0).sum())
        if left in (0, waiting):
            break
        waiting = left
    ahead = pd.array(nodes[reach], "Int64")
    ahead[reach < 0] = pd.NA
    return pd.DataFrame({"node": nodes, "parent": _ids(part.parent), "reach": ahead, "size": size})


def _ranges_locally(part: pd.DataFrame) -> pd.DataFrame:
    nodes = part.node.to_numpy()
    reach, root = places(nodes, _ids(part.reach)), _ids(part.root).to_numpy(np.int64, na_value=np.iinfo(np.int64).min)
    depth, first = part.depth.to_numpy().copy(), part["first"].to_numpy().copy()
    while (reach >= 0).any():
        has = reach >= 0
        up = reach[has]
        known = reach[reach] < 0
        root[has] = np.where(known[has], root[up], root[has])
        depth[has], first[has] = depth[has] + depth[up], first[has] + first[up]
        reach = np.where(has, reach[reach], -1)
    return pd.DataFrame({"node": nodes, "parent": _ids(part.parent), "size": part["size"], "root": root, "depth": depth, "first": first})


def _loops_locally(part: pd.DataFrame) -> pd.DataFrame:
    nodes = part.node.to_numpy()
    jump, ahead = places(nodes, part.reach), places(nodes, part.parent)
    image = len(np.unique(jump))
    while True:
        jump = jump[jump]
        smaller = len(np.unique(jump))
        if smaller == image:
            break
        image = smaller
    low = nodes.copy()
    on = np.zeros(len(nodes), bool)
    on[jump] = True
    while True:
        lower = np.where(on, np.minimum(low, low[ahead]), low)
        ahead = np.where(on, ahead[ahead], ahead)
        if (lower == low).all():
            break
        low = lower
    return pd.DataFrame({"node_id": nodes, "root_id": np.where(on, low, low[jump])})


def sizes_upward(nodes: DataFrame, local_rows: int = LOCAL_ROWS) -> Upward:
    """Subtree sizes of settled ``nodes`` (node, parent; null for roots), leaves to roots.

    Round k adds, to each node, the sizes gathered by the nodes exactly 2**k below it. When a round frees no node though some
    still have an ancestor ahead, these lead into a loop: they stay unprocessed, with the node 2**k above as ``reach``.
    """
    live = nodes.select("node", "parent", F.col("parent").alias("reach"), F.lit(1).cast("long").alias("size"))
    done: list[DataFrame] = []
    waiting = -1
    while True:
        below = live.where("reach is not null")
        gained = below.groupBy(F.col("reach").alias("node")).agg(F.sum("size").alias("gain"))
        grown = live.join(gained, "node", "left")
        above = live.select(F.col("node").alias("reach"), F.col("reach").alias("next"))
        moved = grown.join(above, "reach", "left")
        live = settle(moved.select("node", "parent", F.col("next").alias("reach"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), (F.col("next").isNull() & F.col("gain").isNull()).alias("final")))
        done.append(live.where("final").select("node", "parent", "size"))
        live = live.where("not final").drop("final")
        left = live.where("reach is not null").count()
        if left in (0, waiting):
            done.append(live.where("reach is null").select("node", "parent", "size"))
            return Upward(_union(done), live.where("reach is not null").select("node", "parent", "reach") if left else None)
        if left <= max(local_rows, 0):
            rest = settle(in_one_task(live.selectExpr("node", _exact("parent"), _exact("reach"), "size"), _sizes_locally, "node long, parent long, reach long, size long"))
            done.append(rest.where("reach is null").select("node", "parent", "size"))
            left_over = rest.where("reach is not null").select("node", "parent", "reach")
            return Upward(_union(done), None if left_over.isEmpty() else left_over)
        waiting = left


def ranges_downward(sizes: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Nested-set numbers of the nodes of ``sizes``: node_id, root_id, depth, first, last (preorder numbers within the root's tree), parent_id.

    Each node's number is its parent's plus one plus the sizes of its earlier siblings (by id); the sums along the path to
    the root are taken by doubling, together with depth and root.
    """
    sizes = settle(sizes)
    children = sizes.where("parent is not null").withColumn("block", F.floor(F.col("node") / SIBLING_BLOCK))
    placed = blocked_running_sum(children, ["parent"], "block", ["node"], {"earlier": "size"})
    start = placed.select("node", "parent", "size", F.col("parent").alias("reach"), F.lit(None).cast("long").alias("root"), F.lit(1).cast("long").alias("depth"), (F.col("earlier") + 1).alias("first"))
    tops = sizes.where("parent is null").select("node", "parent", "size", "parent", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("first")).toDF(*start.columns)
    live, done, step = settle(start.unionByName(tops)), [], 1
    while True:
        above = live.where(f"size > {step}").select(F.col("node").alias("reach"), F.col("reach").alias("up_reach"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("first").alias("up_first"))
        moved = live.join(above, "reach", "left")
        live = moved.select(
            "node", "parent", "size", F.col("up_reach").alias("reach"), F.coalesce("root", "up_root").alias("root"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), (F.col("first") + F.coalesce("up_first", F.lit(0))).alias("first"),
        )
        step *= 2
        live = settle(live.withColumn("final", F.expr(f"reach is null and size <= {step}")))
        done.append(live.where("final").drop("final", "reach"))
        live = live.where("not final").drop("final")
        left = live.where("reach is not null").count()
        if left <= max(local_rows, 0):
            if left:
                live = in_one_task(live.selectExpr("node", _exact("parent"), "size", _exact("reach"), _exact("root"), "depth", "first"), _ranges_locally, "node long, parent long, size long, root long, depth long, first long")
            done.append(live.drop("reach"))
            break
    return _union(done).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"), F.col("parent").alias("parent_id"))


def resolve_loops(unprocessed: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """node_id and root_id, the smallest id of its loop, of the nodes on or below loops (node, parent, reach).

    Doubling ``reach`` until its image stops shrinking leaves exactly the nodes on loops in the image; their smallest id is
    then spread around each loop by doubling as well.
    """
    jump = settle(unprocessed)
    if jump.count() <= local_rows:
        return in_one_task(jump, _loops_locally, "node_id long, root_id long")
    size = jump.select("reach").distinct().count()
    while True:
        above = jump.select(F.col("node").alias("reach"), F.col("reach").alias("next"))
        jump = settle(jump.join(above, "reach").select("node", "parent", F.col("next").alias("reach")))
        smaller = jump.select("reach").distinct().count()
        if smaller == size:
            break
        size = smaller
    on_loop = jump.select(F.col("reach").alias("node")).distinct()
    ring = settle(jump.join(on_loop, "node").select("node", F.col("parent").alias("next"), F.col("node").alias("low")))
    while True:
        ahead = ring.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        ring = settle(ring.join(ahead, "next").select("node", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        if ring.where("changed").isEmpty():
            break
        ring = ring.drop("changed")
    low = ring.select("node", "low")
    below = jump.join(on_loop, "node", "left_anti").join(low.withColumnRenamed("node", "reach"), "reach").select("node", "low")
    return low.unionByName(below).select(F.col("node").alias("node_id"), F.col("low").alias("root_id"))


def hierarchy(links: DataFrame, parent: str = "parent_id", child: str = "child_id", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Each id of any link: node_id, root_id, depth, first, last, parent_id.

    A node's descendants are the nodes of the same root whose ``first`` lies above its own and up to its ``last``. Ids on or
    below a loop have depth -1, null ranges and, as root_id, the loop's smallest id; an id that is its own parent is a loop.
    Repeated links count once, links with a null end not at all, and no links give no rows. A counted remainder of at most
    ``local_rows`` waiting nodes finishes in one task; with 0 every round is distributed.
    """
    edges = settle(distinct_links(links, parent, child))
    up = sizes_upward(settle(with_roots(edges)), local_rows)
    nodes = ranges_downward(up.sizes, local_rows)
    if up.unprocessed is None:
        return nodes
    none = F.lit(None).cast("long")
    loops = resolve_loops(up.unprocessed, local_rows).join(edges.withColumnRenamed("node", "node_id"), "node_id")
    return nodes.unionByName(loops.select("node_id", "root_id", F.lit(-1).cast("long").alias("depth"), none.alias("first"), none.alias("last"), F.col("parent").alias("parent_id")))


def _dyadic(low: str, high: str) -> str:
    """SQL of the aligned blocks (level, block) that exactly cover the closed range ``low``..``high``: at most two a level."""
    steps = f"sequence(0, greatest(0, cast(ceil(log2({high} - {low} + 2)) as int)))"
    left = f"shiftright({low} + shiftleft(1L, l) - 1, l)"
    right = f"shiftright({high} + 1, l)"
    first = f"if({left} < {right} and {left} % 2 = 1, array(named_struct('level', l, 'block', {left})), array())"
    last = f"if({left} < {right} and {right} % 2 = 1, array(named_struct('level', l, 'block', {right} - 1)), array())"
    return f"array_distinct(flatten(transform({steps}, l -> concat({first}, {last}))))"


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (node_id, ancestor_id, steps) of the ids in ``of`` (node_id), by the nested-set ranges of ``nodes``: exact for any depth.

    A node's range below it is cut into aligned blocks, at most two a level, and each asked place lies in one block a level,
    so the join has only equal keys, and even one tree with all nodes is spread over as many keys as it has blocks. Nodes on
    or below loops have no ancestors here.
    """
    asked = nodes.join(of.select("node_id").distinct(), "node_id").where("depth > 0").select("node_id", "root_id", F.col("depth").alias("d"), F.col("first").alias("f"))
    places = asked.select("*", F.expr("explode(transform(sequence(0, 62), l -> named_struct('level', l, 'block', shiftright(f, l))))").alias("b")).select("node_id", "root_id", "d", "b.level", "b.block")
    above = nodes.where("depth >= 0 and last > first").select(F.col("node_id").alias("ancestor_id"), "root_id", "depth", F.expr(f"explode({_dyadic('(first + 1)', 'last')})").alias("b")).select("ancestor_id", "root_id", "depth", "b.level", "b.block")
    levels = above.agg(F.max("level").alias("top"))
    places = beside(places, levels).where("level <= top").drop("top")
    return places.join(above, ["root_id", "level", "block"]).select("node_id", "ancestor_id", (F.col("d") - F.col("depth")).alias("steps"))


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (node_id, descendant_id, steps) of the ids in ``of`` (node_id), by nested-set ranges, in blocks of RANGE_BLOCK places.

    An asked range is sent to the blocks it touches, about its size over RANGE_BLOCK, so no key holds more than a block's nodes.
    """
    asked = nodes.join(of.select("node_id").distinct(), "node_id").where("depth >= 0 and last > first").select("node_id", "root_id", F.col("depth").alias("d"), F.col("first").alias("f"), F.col("last").alias("l"))
    sent = asked.withColumn("block", F.explode(F.sequence(F.floor((F.col("f") + 1) / RANGE_BLOCK), F.floor(F.col("l") / RANGE_BLOCK))))
    below = nodes.where("depth > 0").select(F.col("node_id").alias("descendant_id"), "root_id", "depth", "first", F.floor(F.col("first") / RANGE_BLOCK).alias("block"))
    inside = (F.col("first") > F.col("f")) & (F.col("first") <= F.col("l"))
    return sent.join(below, ["root_id", "block"]).where(inside).select("node_id", "descendant_id", (F.col("depth") - F.col("d")).alias("steps"))


def path_pieces(nodes: DataFrame, piece: int = PATH_PIECE, separator: str = "/") -> DataFrame:
    """The scalable form of paths: node_id, head_id and the path from the head (left out) to the node, of at most ``piece`` steps.

    The head is the nearest ancestor whose depth is a multiple of ``piece``, null for a root, so the table grows with the nodes
    only, and a full path is the chain of the pieces of its heads. Nodes on or below loops have no piece.
    """
    live = settle(nodes.where("depth >= 0").select("node_id", F.col("parent_id").alias("reach"), (F.col("depth") - 1).alias("at"), F.col("node_id").cast("string").alias("path")))
    step = 1
    while step < piece:
        above = live.select(F.col("node_id").alias("reach"), F.col("reach").alias("next"), F.col("at").alias("next_at"), F.col("path").alias("before"))
        done = (F.col("at") < 0) | (F.col("at") % piece == 0)
        live = settle(live.join(above, "reach", "left").select(
            "node_id", F.when(done, F.col("reach")).otherwise(F.col("next")).alias("reach"), F.when(done, F.col("at")).otherwise(F.col("next_at")).alias("at"),
            F.when(done, F.col("path")).otherwise(F.concat_ws(separator, "before", "path")).alias("path"),
        ))
        step *= 2
    return live.select("node_id", F.col("reach").alias("head_id"), "path")


def paths(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """node_id and its full path from the root as text, for every node that hangs from a root; built by doubling path pieces."""
    rows = nodes.where("depth >= 0")
    live = settle(rows.select("node_id", F.col("parent_id").alias("reach"), F.col("node_id").cast("string").alias("path"), (F.col("last") - F.col("first") + 1).alias("size")))
    done, step = [], 1
    while True:
        above = live.where(f"size > {step}").select(F.col("node_id").alias("reach"), F.col("reach").alias("next"), F.col("path").alias("head"))
        moved = live.join(above, "reach", "left").select("node_id", F.col("next").alias("reach"), F.concat_ws(separator, "head", "path").alias("path"), "size")
        step *= 2
        live = settle(moved.withColumn("final", F.expr(f"reach is null and size <= {step}")))
        done.append(live.where("final").select("node_id", "path"))
        live = live.where("not final").drop("final")
        if live.where("reach is not null").isEmpty():
            done.append(live.select("node_id", "path"))
            return _union(done)
