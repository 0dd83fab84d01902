"""Exports in, stored tables, streams, caches, questions, and the registry."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chatlake.operators import fulltext, vectors
from chatlake.operators.caching import LRUCache, Version, cached
from chatlake.operators.membership import BloomFilter, bloom_of
from chatlake.operators.hierarchy import hierarchy
from chatlake.operators.threads import reply_edges
from chatlake.plans import questions, registry
from chatlake.plans.service import ChatService
from chatlake.sinks.store import Store, as_json, messages_export, users_export
from chatlake.sources import chat_export, live_rows
from chatlake.sources.live import LiveChat
from chatlake.streaming import sync


FIRST, START = 70_001, 1_451_606_400
LINES = ["the gate was open again", "who took the ladder", "soup at noon, bring bowls"]


def message(n, **more):
    """The n-th exported message: three members by turns, a quarter of an hour apart."""
    row = {"id": FIRST + n, "type": "message", "date": "2016-01-01T00:00:00", "date_unixtime": str(START + 900 * n), "from": ("Orla", "Pim", "Quist")[n % 3], "from_id": f"user{31 + n % 3}"}
    return row | {"text": f"{LINES[n % 3]}, note {n}", "text_entities": [{"type": "plain", "text": "x"}]} | more


ODD = message(1, text=["See ", {"type": "link", "text": "https://e.x"}, " now", 5], text_entities=[{"type": "link", "text": "https://e.x"}, {"type": "mention"}, {"text": "plain"}], photo="p.jpg", edited="2024", edited_unixtime="17", reply_to_message_id=7)


def test_reads_objects_lists_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "x", "messages": [message(0), ODD, {"id": 5, "type": "service"}]}))
    (tmp_path / "b.json").write_text("  " + json.dumps([message(2)]))
    (tmp_path / "c.jsonl").write_text(json.dumps(message(3)) + "\nbroken{\n")
    whole = chat_export.parsed(chat_export.read_export(spark, str(tmp_path / "a.json"))).orderBy("id").collect()
    assert [r.id for r in whole] == [FIRST, FIRST + 1] and chat_export.count_messages(chat_export.read_export(spark, str(tmp_path / "a.json"))) == 2
    r = whole[1]
    assert (r.text_plain, r.text_length, r.has_links, r.has_mentions, r.has_photo, r.has_media, r.is_edited, r.edited_unixtime, r.reply_to_message_id) == ("See https://e.x now", 19, 1, 1, 1, 1, 1, 17, 7)
    assert [(e.type, e.value) for e in r.entities] == [("link", "https://e.x"), ("mention", "")]
    assert (whole[0].has_media, whole[0].is_edited, whole[0].date_unixtime, whole[0].forwarded_from) == (0, 0, START, None)
    assert chat_export.structure(spark, str(tmp_path / "b.json")) == "list" and chat_export.structure(spark, str(tmp_path / "a.json")) == "object"
    assert chat_export.parsed(chat_export.read_export(spark, str(tmp_path / "b.json"))).count() == 1
    assert chat_export.parsed(chat_export.read_lines(spark, str(tmp_path / "c.jsonl"))).count() == 1
    assert [r.value for r in chat_export.broken_lines(spark, str(tmp_path / "c.jsonl")).collect()] == ["broken{"]
    assert chat_export.parsed(chat_export.read_export(spark, f"{tmp_path}/*.json")).count() == 3


@pytest.mark.parametrize("chunk", [1, 7, 64, 4_000_000])
def test_elements_are_found_whatever_the_pieces(tmp_path, chunk):
    rows = [{"id": 1, "text": 'a "quoted" ]} text'}, 12, "str", {"deep": [{"messages": [1]}]}, None, True, 4.5, [], {}]
    for n, text in enumerate((json.dumps(rows), json.dumps({"name": "x", "list": [1, 2], "messages": rows, "after": 1}, indent=2), "\ufeff" + json.dumps(rows))):
        (tmp_path / f"{n}.json").write_text(text, encoding="utf-8")
        assert [json.loads(e) for e in chat_export.elements(str(tmp_path / f"{n}.json"), chunk)] == rows
    for text in ("[1, 2", '{"a": 1}', '"x"', "", '{"messages": [1, 2}', "[1 2]"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            list(chat_export.elements(str(tmp_path / "bad.json"), chunk))


def test_a_large_export_gives_all_its_messages(spark, tmp_path):
    row = json.dumps(message(5, text="x" * 4000))
    with open(tmp_path / "large.json", "w") as out:
        out.write('{"name": "large", "messages": [' + ",\n".join([row] * 50_000) + "]}")
    assert (tmp_path / "large.json").stat().st_size > 200_000_000
    assert chat_export.read_export(spark, str(tmp_path / "large.json")).count() == 50_000


def lines(spark, tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return chat_export.parsed(chat_export.read_lines(spark, str(path)))


def test_index_then_update_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = lines(spark, tmp_path, "1.jsonl", [message(n, reply_to_message_id=FIRST + n - 1 if n else None) for n in range(5)] + [message(0, text="later copy")])
    assert store.index(first)["messages"] == 5
    again = lines(spark, tmp_path, "2.jsonl", [message(n, text="changed gate", reply_to_message_id=FIRST + 4 if n == 7 else None) for n in range(10)])
    assert store.update(again) == {"new_messages": 5, "duplicates": 5}
    assert store.update(again) == {"new_messages": 0, "duplicates": 10}
    rows = {r.id: r for r in store.read("messages").collect()}
    assert rows[FIRST].text_plain == "the gate was open again, note 0" and rows[FIRST + 9].text_plain == "changed gate" and len(rows) == 10
    assert sorted(r.delivery_id for r in rows.values()) == list(range(1, 11))
    users = {r.from_id: r for r in store.read("users").collect()}
    assert sum(r.message_count for r in users.values()) == 10 and users["user31"].display_name == "Orla"
    whole = hierarchy(reply_edges(store.read("messages")))
    columns = ["node_id", "root_id", "depth", "first", "last", "parent_id"]
    assert sorted(map(tuple, store.read("nodes").select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    assert [(r.n_messages, r.n_nodes, r.max_depth) for r in store.read("threads").collect()] == [(6, 6, 5)]
    built = fulltext.build_index(store.read("messages"))
    for query in ("gate", '"the gate"', "note NOT gate", "ladd*"):
        hits = [{(r.id, round(r.score, 9)) for r in fulltext.match(i, query).collect()} for i in (store.fulltext(), built)]
        assert hits[0] == hits[1] and hits[0]
    assert [tuple(r) for r in fulltext.okapi(store.okapi(), "gate note").collect()] == [tuple(r) for r in fulltext.okapi(fulltext.okapi_index(store.read("messages")), "gate note").collect()]
    assert fulltext.fuzzy(store.read("trigrams"), "changed gate").count() == 5
    store.compact("messages", 1)
    assert store.read("messages").count() == 10 and users_export(store.read("messages")).count() == 3
    assert messages_export(store.read("messages"), 3).count() == 3 and json.loads(as_json(store.read("messages")).first()["json"])["id"] >= FIRST
    assert store.replace(lines(spark, tmp_path, "3.jsonl", [message(2, text="edited"), message(20)]))["messages"] == 11
    rows = {r.id: r.text_plain for r in store.read("messages").collect()}
    assert rows[FIRST + 2] == "edited" and rows[FIRST + 9] == "changed gate" and store.read("documents").count() == 11


def test_a_failed_load_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.index(lines(spark, tmp_path, "1.jsonl", [message(n) for n in range(3)]))
    before, part = store.manifest(), Store.part
    monkeypatch.setattr(Store, "part", lambda self, name, *rest: (_ for _ in ()).throw(OSError("disk")) if name == "trigrams" else part(self, name, *rest))
    more = lines(spark, tmp_path, "2.jsonl", [message(n, text_entities=[{"type": "link", "text": "https://a.x"}]) for n in range(6)])
    with pytest.raises(OSError):
        store.update(more)
    assert store.manifest() == before and store.read("entities").count() == 0
    monkeypatch.undo()
    assert store.update(more) == {"new_messages": 3, "duplicates": 3} and store.read("entities").count() == 3
    assert store.read("messages").select("delivery_id").distinct().count() == 6
    with pytest.raises(RuntimeError):
        store.publish(before, {})


def test_vectors_and_chunks_are_written(spark, chat, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = chat({"id": 1, "text_plain": "a text of some length"}, {"id": 2, "text_plain": "short"}, {"id": 3, "text_plain": "another longer text"})
    assert store.embed(rows) == 2 and store.embed(rows) == 2
    assert store.embed_chunks(spark.createDataFrame([(1, "one chunk", [1, 3])], "chunk_id long, text string, message_ids array<long>")) == 1
    assert len(store.read("chunks").first()["embedding"]) == 64


def test_live_rows_become_messages_and_members(spark):
    person, group = {"id": 5, "first_name": "Ann", "last_name": "Orr"}, {"id": 9, "title": "Board"}
    rows = [
        {"id": 1, "text": "see x.y and here", "date_unixtime": START, "sender": person, "entities": [{"kind": "url", "start": 4, "length": 3}, {"kind": "text_url", "start": 12, "length": 4, "url": "https://h"}, {"kind": "spoiler", "start": 0, "length": 3}, {"kind": "mention_name", "start": 0, "length": 3}]},
        {"id": 2, "text": " \u200e ".replace("\u200e", ""), "sender": person}, {"id": 3, "text": None}, {"id": 4, "text": "x", "sender": group, "forward": {"name": "Zed"}, "photo": {"width": 2, "height": 3}, "reply_to": 1, "edited_unixtime": 8},
        {"id": 5, "text": "y", "forward": {"sender": group}, "has_file": True},
    ]
    got = {r.id: r for r in live_rows.live_messages(spark.createDataFrame(rows, live_rows.LIVE_MESSAGE)).collect()}
    assert sorted(got) == [1, 4, 5]
    one, four, five = got[1], got[4], got[5]
    assert (one.from_name, one.from_id, one.date, one.has_links, one.has_mentions, one.is_edited) == ("Ann Orr", "user5", "2016-01-01T00:00:00", 1, 1, 0)
    assert [(e.type, e.value) for e in one.entities] == [("link", "x.y"), ("text_link", "https://h"), ("mention", "see")]
    assert (four.from_name, four.from_id, four.forwarded_from, four.has_photo, four.has_media, four.photo_height, four.reply_to_message_id, four.is_edited) == ("Board", "channel9", "Zed", 1, 1, 3, 1, 1)
    assert (five.from_name, five.from_id, five.forwarded_from, five.forwarded_from_id, five.has_media, five.date_unixtime) == ("", "", "Board", "channel9", 1, 0)
    members = [{"id": 1, "role": "creator", "status": "online"}, {"id": 2, "role": "admin", "status": "offline", "seen": 7}, {"id": 3, "status": "away", "is_bot": True}, {"id": None}]
    got = {r.user_id: r for r in live_rows.live_participants(spark.createDataFrame(members, live_rows.LIVE_MEMBER), 99).collect()}
    assert [(r.is_admin, r.is_creator, r.last_status, r.last_online, r.is_bot) for _, r in sorted(got.items())] == [(1, 1, "online", 99, 0), (1, 0, "offline", 7, 0), (0, 0, "unknown", None, 1)]


def test_service_answers_from_cache_and_hits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.index(lines(spark, tmp_path, "1.jsonl", [message(n, reply_to_message_id=FIRST + n - 1 if n else None) for n in range(6)]))
    service = ChatService(store)
    assert [r["id"] for r in service.search("ladder", 5)] == [r["id"] for r in service.search("ladder", 5)] == [FIRST + 1, FIRST + 4]
    assert service.cache.hits == 1 and service.rank("user31")[0]["rank"] == 1 and service.rank("nobody") == []
    store.update(lines(spark, tmp_path, "2.jsonl", [message(7, text="one more ladder")]))
    assert len(service.search("ladder", 5)) == 3 and service.cache.hits == 1
    assert service.vector_status()["available"] is False
    store.embed(store.read("messages"))
    assert service.vector_status()["n_vectors"] == 7
    chunks = vectors.encoded(spark.createDataFrame([(1, "who took the ladder", [FIRST + 1, FIRST + 4])], "chunk_id long, text string, message_ids array<long>"), "text")
    asked = []
    found = service.answer_with_search("ladder", lambda p: asked.append(p) or "Pim", chunks, 2, 1)
    assert found["answer"] == "Pim" and {s["message_id"] for s in found["sources"]} <= {FIRST + 1, FIRST + 4, FIRST + 7} and "who took the ladder" in asked[0]
    found = service.answer_by_meaning("who took the ladder", lambda p: "x" if "soup at noon" in p else "no", 3)
    assert found["answer"] == "x" and len(found["results"]) == 3 and found["total_with_threads"] >= 4


def test_members_and_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "user_id string, first_name string, updated_at long"
    store.upsert_participants(spark.createDataFrame([("a", "old", 5), ("b", "b", 1)], schema))
    store.upsert_participants(spark.createDataFrame([("a", "new", 5), ("b", "stale", 0), ("c", "c", 1)], schema))
    assert {r.user_id: r.first_name for r in store.read("participants").collect()} == {"a": "new", "b": "b", "c": "c"}
    one = spark.createDataFrame([(1, [1.0])], "message_id long, embedding array<float>")
    assert store.append_vectors(one) == 1 and store.append_vectors(one) == 1


def test_stream_delivers_once(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "1.jsonl").write_text("\n".join(json.dumps(message(n)) for n in range(4)))
    store, told = Store(spark, str(tmp_path / "store")), []
    for extra in range(2):
        (drop / f"x{extra}.jsonl").write_text("\n".join(json.dumps(message(n)) for n in range(3, 6)))
        sync.sync(sync.message_stream(spark, str(drop)), store, str(tmp_path / "check"), told.append).awaitTermination()
    assert store.read("messages").count() == 6 and len(told) == 2
    stream = sync.message_stream(spark, str(drop))
    for name, frame, mode in (("hours", sync.hourly_counts(stream), "complete"), ("once", sync.once_within(stream).select("id"), "append"), ("visits", sync.activity_sessions(stream), "append")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hours").agg(F.sum("count")).first()[0] == 10 and spark.table("once").count() == 6


def test_live_source(spark, tmp_path):
    path = tmp_path / "live.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [message(0), message(1, text=" "), message(2)]))
    spark.dataSource.register(LiveChat)
    assert spark.read.format("live_chat").option("path", str(path)).load().count() == 2
    assert spark.read.format("live_chat").option("path", str(path)).option("since", START + 1800).load().count() == 1


def test_bloom_filter(spark):
    assert (BloomFilter(1_000_000, 0.01).size, BloomFilter(1_000_000, 0.01).hashes) == (9_585_058, 6)
    found = bloom_of(spark.range(2000), "id", 2000, 0.01)
    assert all(n in found for n in range(2000)) and sum(n in found for n in range(10_000, 20_000)) < 300 and len(found) == 2000


def test_cache():
    cache, version, calls = LRUCache(2), Version(), []

    @cached(cache, version=version)
    def double(x):
        calls.append(x)
        return None if x == 0 else 2 * x

    assert [double(1), double(1), double(0), double(0)] == [2, 2, None, None] and calls == [1, 0, 0]
    version.invalidate()
    assert double(1) == 2 and calls == [1, 0, 0, 1] and cache.stats()["hits"] == 1
    double(2), double(3)
    assert cache.stats()["size"] == 2


def test_questions(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(5).createOrReplaceTempView("numbers")
    assert questions.extract_sql("Sure:\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert questions.gate(spark, "WITH x AS (SELECT id FROM numbers) SELECT * FROM x", ["numbers"]).count() == 5
    (Path(folder) / "secret.txt").write_text("secret")
    spark.range(3).createOrReplaceTempView("secrets")
    for bad in (
        "DROP TABLE numbers", "SELECT * FROM secrets", "SELECT * FROM numbers; SELECT 1", "INSERT INTO numbers VALUES (1)", f"WITH text AS (SELECT 1) SELECT * FROM text.`{folder}/secret.txt`",
        f"SELECT * FROM text.`{folder}/secret.txt`", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT java_method('java.lang.System', 'getProperty', 'user.name')", "SELECT * FROM range(5)",
        "SELECT * FROM (WITH secrets AS (SELECT 1) SELECT * FROM secrets) a, secrets", "SELECT (SELECT max(id) FROM secrets) AS m FROM numbers", "SELECT input_file_name() FROM numbers", "SELECT TRANSFORM(id) USING 'cat' FROM numbers",
        f"SELECT {', '.join(f'id AS c{n}' for n in range(60))}, reflect('java.lang.System', 'getProperty', 'user.name') AS z FROM numbers",
    ):
        with pytest.raises(Exception):  # noqa: B017
            questions.gate(spark, bad, ["numbers"]).count()
    for good in ("SELECT count(*) AS n, round(avg(id), 1) AS m FROM numbers WHERE id IN (1, 2) AND cast(id AS string) LIKE '%1%'", "SELECT id, row_number() OVER (ORDER BY id) AS n FROM numbers WHERE id > (SELECT min(id) FROM numbers)", "SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS k, sum(id) FROM numbers GROUP BY 1 HAVING sum(id) > 0"):
        assert questions.gate(spark, good, ["numbers"]).count() > 0
    found = questions.answer_with_sql(spark, "how many?", lambda p: "SELECT count(*) AS n FROM numbers" if "SQL:" in p else "five", ["numbers"])
    assert found["rows"] == [{"n": 5}] and found["answer"] == "five"
    assert "error" in questions.answer_with_sql(spark, "?", lambda p: "I can't", ["numbers"])
    assert "id" in questions.describe(spark, ["numbers"])
    assert questions.dispatch("auto", lambda: {"error": "x"}, lambda: {"answer": "ctx"}, dict)["answer"] == "ctx"


def test_the_entry_module_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_every_sql_has_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


def test_unseen_messages_of_every_id(spark, chat, tmp_path):
    chat(*[{"id": n, "text_plain": "x"} for n in range(1, 8)]).write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([(2,), (5,), (5,)], "message_id long").write.parquet(f"{tmp_path}/message_embeddings.parquet")
    got = registry.queries()["snk2_unseen"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == [1, 3, 4, 6, 7]


def test_scores_exclusion_and_export_take_every_message(spark, chat, tmp_path):
    texts = ["the water bill before the storm", "a", "", None, "the water bill before the storm, and a text of more than sixty characters"]
    senders = ["user200000037", "b", "b", "b", "c"]
    chat(*[{"id": n, "text_plain": t, "from_id": w} for n, (t, w) in enumerate(zip(texts, senders, strict=True), 1)]).write.parquet(f"{tmp_path}/messages.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    scores = {r.id: r.similarity for r in run("sim1_2_trigram_similarity")}
    assert scores.keys() == {1, 2, 3, 4, 5} and scores[1] == 1 and scores[2] == scores[3] == scores[4] == 0 and 0 < scores[5] < 1
    assert {r.id for r in run("fil10_exclude_self")} == {2, 3, 4, 5}
    assert sorted(json.loads(r.json)["id"] for r in run("snk16_json")) == [1, 2, 3, 4, 5]
