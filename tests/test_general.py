"""Repeated deliveries, hierarchies, sessions: small cases against plain Python, with nulls, ties, loops, hot keys and empty tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlake.operators import hierarchy as H
from chatlake.operators.dedup import SeenRanges, kept_copies, not_yet_seen, resolve_deliveries, seen_ranges
from chatlake.operators.running import blocked_running_sum, ranged_running_sum
from chatlake.operators.sessions import sessionize


def best(rows):
    kept, alone = {}, []
    for r in rows:
        if r["id"] is None:
            alone.append(r["delivery_id"])
            continue
        key = (0 if r.get("is_edited") == 1 else 1, -(r.get("edited_unixtime") or 0), 0 if (r.get("date_unixtime") or 0) > 0 else 1, r["delivery_id"])
        if r["id"] not in kept or key < kept[r["id"]]:
            kept[r["id"]] = key
    return sorted([k[-1] for k in kept.values()] + alone)


def test_deliveries_keep_one_copy(chat):
    rng = random.Random(1)
    rows = [{"delivery_id": n, "id": rng.choice([None, 0, -3, 7, 7, 7, rng.randrange(1, 90), 70_000 + rng.randrange(40)]), "is_edited": rng.choice([0, 1, None]), "edited_unixtime": rng.choice([None, 5, 9]), "date_unixtime": rng.choice([0, 100, None])} for n in range(1, 600)]
    table = chat(*rows)
    found = resolve_deliveries(table).collect()
    assert len(found) == len(rows)
    assert sorted(r.delivery_id for r in found if r.accepted) == best(rows)
    assert sorted(r.delivery_id for r in kept_copies(table).collect()) == best(rows)


def test_deliveries_of_an_empty_table_and_clashing_columns(chat):
    assert resolve_deliveries(chat().withColumn("accepted", F.lit(1)).withColumn("lost", F.lit(1))).count() == 0


def test_a_hot_id_is_settled(chat):
    found = resolve_deliveries(chat(*[{"id": 5} for _ in range(300)], {"id": 6})).where("accepted").collect()
    assert sorted((r.id, r.delivery_id) for r in found) == [(5, 1), (6, 301)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=20), max_size=8))
def test_ranges_stay_disjoint_and_cover_what_was_added(parts):
    ranges, seen = SeenRanges(), set()
    for part in parts:
        assert ranges.covers(np.array(part)).tolist() == [x in seen for x in part]
        ranges.add(np.sort(np.array(part)))
        seen |= set(part)
        assert (ranges.low[1:] > ranges.high[:-1] + 1).all()
    assert {x for a, b in zip(ranges.low, ranges.high, strict=True) for x in range(a, b + 1)} == seen


def test_stored_ranges_hide_seen_ids(chat):
    old = chat({"id": 1}, {"id": 2}, {"id": 5}, {"id": None})
    assert sorted((r.low, r.high) for r in seen_ranges(old).collect()) == [(1, 2), (5, 5)]
    fresh = not_yet_seen(chat({"id": 2}, {"id": 3}, {"id": None}, {"id": -1}), seen_ranges(old))
    assert sorted(r.id for r in fresh.where("id is not null").collect()) == [-1, 3]


def expected_tree(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for node in set(parent) | set(parent.values()):
        path, at = [node], node
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if at in parent:
            loop = path[path.index(parent[at]) :]
            out[node] = (min(loop), -1)
        else:
            out[node] = (at, len(path) - 1)
    return out


@pytest.mark.parametrize("local", [100_000, 0])
def test_trees_loops_and_ranges(spark, local):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(1, n), n) for n in range(2, 60)] + [(70, 71), (71, 72), (72, 70), (72, 73), (73, 74), (80, 80), (None, 4), (5, None), (1, 2)]
    table = spark.createDataFrame([(a, b, 1) for a, b in links], "parent_id long, child_id long, depth int")
    nodes = H.hierarchy(table, local_rows=local).collect()
    assert {r.node_id: (r.root_id, r.depth) for r in nodes} == expected_tree(links)
    by_id = {r.node_id: r for r in nodes if r.depth >= 0}
    for r in by_id.values():
        below = {x.node_id for x in by_id.values() if x.root_id == r.root_id and r.first < x.first <= r.last}
        children = {x.node_id for x in by_id.values() if x.parent_id == r.node_id}
        assert children <= below and len(below) == r.last - r.first
    assert sorted((r.root_id, r.first) for r in by_id.values()) == sorted({(r.root_id, r.first) for r in by_id.values()})
    frame = spark.createDataFrame(nodes, H.hierarchy(table).schema)
    chain = {r.node_id: r.path for r in H.paths(frame).collect()}
    assert chain[1005] == "1000/1001/1002/1003/1004/1005" and len(chain) == len(by_id)
    asked = spark.createDataFrame([(1003,)], "node_id long")
    assert sorted((r.ancestor_id, r.steps) for r in H.ancestors(frame, asked).collect()) == [(1000, 3), (1001, 2), (1002, 1)]
    assert H.descendants(frame, asked).count() == 37
    everybody = frame.select("node_id").withColumn("depth", F.lit("clash"))
    parent = {r.node_id: r.parent_id for r in by_id.values()}
    wanted = set()
    for node in by_id:
        at, steps = parent[node], 1
        while at is not None:
            wanted.add((node, at, steps))
            at, steps = parent[at], steps + 1
    assert {tuple(r) for r in H.ancestors(frame, everybody).collect()} == wanted
    assert {(r.descendant_id, r.node_id, r.steps) for r in H.descendants(frame, everybody).collect()} == wanted
    pieces = {r.node_id: r for r in H.path_pieces(frame, 8).collect()}
    assert pieces.keys() == by_id.keys() and max(len(r.path.split("/")) for r in pieces.values()) == 8
    for node, path in chain.items():
        parts, at = [], node
        while at is not None:
            parts, at = [pieces[at].path, *parts], pieces[at].head_id
        assert "/".join(parts) == path
    assert sorted(map(tuple, H.conflicting_links(spark.createDataFrame([(1, 9), (2, 9), (2, 9), (1, 8), (None, 8)], "parent_id long, child_id long")).collect())) == [(9, 2)]


def test_a_parent_with_many_children(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLING_BLOCK", 16)
    table = spark.createDataFrame([(1, n) for n in range(2, 202)], "parent_id long, child_id long")
    assert sorted((r.node_id, r.first) for r in H.hierarchy(table).collect()) == [(n, n - 1) for n in range(1, 202)]


def test_no_links(spark):
    assert H.hierarchy(spark.createDataFrame([], "parent_id long, child_id long")).count() == 0


def expected_sessions(rows, gap):
    by = {}
    for r in rows:
        if r.get("from_id") and (r.get("date_unixtime") or 0) > 0:
            by.setdefault(r["from_id"], []).append(r["date_unixtime"])
    out = []
    for who, times in by.items():
        times.sort()
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((who, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((who, start, last, n))
    return sorted(out)


def test_sessions_across_block_borders(chat):
    rng = random.Random(5)
    rows = [{"from_id": rng.choice(["a", "a", "a", "b", "", None]), "date_unixtime": rng.choice([0, None, 100, 100, rng.randrange(1, 400), 1000 + rng.randrange(60)])} for _ in range(400)]
    for gap, block in ((5, 20), (30, 64), (1800, 86_400)):
        assert sorted(tuple(r) for r in sessionize(chat(*rows), gap=gap, block=block).collect()) == expected_sessions(rows, gap)
    assert sessionize(chat()).count() == 0
    with pytest.raises(ValueError, match="block"):
        sessionize(chat(), gap=10, block=10)


def test_running_sums_over_ranges_of_a_burst(spark):
    rows = [("a", n % 3, n, 1) for n in range(300)] + [("b", 0, 1, 5)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long").withColumn("block", F.lit(0))
    got = {(r.k, r.at, r.id): r.s for r in ranged_running_sum(df, ["k"], ["at", "id"], {"s": "v"}).collect()}
    assert [got[key] for key in sorted(k for k in got if k[0] == "a")] == list(range(300)) and got["b", 0, 1] == 0
    whole = ranged_running_sum(df, [], ["k", "at", "id"], {"s": "v"})
    assert [r.s for r in whole.orderBy("k", "at", "id").collect()] == list(range(301)) and whole.where("false").count() == 0
    assert ranged_running_sum(df.where("false"), ["k"], ["at"], {"s": "v"}).count() == 0


def test_later_loads_are_accepted_against_stored_ranges(chat):
    rows = [{"id": 5, "is_edited": 1}, {"id": 5}, {"id": 7}, {"id": 8}, {"id": -3}, {"id": None}, {"id": 70_000}, {"id": 70_001}]
    old = seen_ranges(chat({"id": 8}, {"id": 6}, {"id": 7}, {"id": 70_001}))
    found = resolve_deliveries(chat(*rows), seen=old).collect()
    assert sorted((r.id or 0, r.delivery_id) for r in found if r.accepted) == [(-3, 5), (0, 6), (5, 1), (70_000, 7)] and len(found) == 8


def test_running_sums_by_block(spark):
    rows = [("a", n % 7, n, n * 2) for n in range(50)] + [("b", 0, 1, 5)]
    df = spark.createDataFrame(rows, "k string, block long, o long, v long")
    got = {(r.k, r.block, r.o): r.s for r in blocked_running_sum(df, ["k"], "block", ["o"], {"s": "v"}).collect()}
    for k, block, o, _ in rows:
        assert got[k, block, o] == sum(v for k2, b2, o2, v in rows if k2 == k and (b2, o2) < (block, o))
