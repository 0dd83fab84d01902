"""Full-text search against SQLite's engine, threads, similar texts, vectors, chunks, hybrid search, styles."""

import random
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatlake.operators import chunks, fulltext, hybrid, replies, similarity, stylometry, threads, vectors
from chatlake.operators.hierarchy import hierarchy
from chatlake.plans import fts_query as Q

TEXTS = [
    ("the big water bill", "Ann"), ("water under the bridge, the bill came later", "Bob"), ("café society and the CAFE", "Ann Water"), ("bill bill bill", "Bill"), ("nothing here", None), ("", "Zed"),
    ("snake_case and x-y words", "Ann"), ("storm warning: water rises before the storm", "Cy"), ("Ünïcode wörds", "Dee"), ("photographs of photographers", "Eve"),
]
QUERIES = ["water", "water bill", "water OR storm", "bill NOT water", '"water bill"', "photo*", "cafe", "text_plain : ann", "from_name : ann", "^ the", "NEAR(water bill, 2)", "NEAR(water storm)", "(storm OR bill) AND water", "case x", '"big water" OR nothing', "unicode words"]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([(n, t, w) for n, (t, w) in enumerate(TEXTS, 1)], "id long, text_plain string, from_name string")
    found = fulltext.build_index(rows)
    return fulltext.Index(found.table.cache(), found.documents.cache(), found.totals.cache())


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_scores_are_those_of_sqlite(index, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text_plain, from_name, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, text_plain, from_name) VALUES (?, ?, ?)", [(n, t, w) for n, (t, w) in enumerate(TEXTS, 1)])
    wanted = {n: s for n, s in con.execute("SELECT rowid, bm25(f, 1.0, 0.5) FROM f WHERE f MATCH ?", (query,))}
    got = {r.id: r.score for r in fulltext.match(index, query).collect()}
    assert got.keys() == wanted.keys()
    if "NEAR" not in query and "NOT" not in query:
        assert all(abs(got[n] - wanted[n]) < 1e-6 for n in wanted)


@pytest.mark.parametrize("query", ["", "AND water", "water AND", '(water', "nosuch : water", "NEAR()"])
def test_malformed_queries_are_refused(query):
    with pytest.raises(Q.QueryError):
        Q.parse(query, ("text_plain", "from_name"), fulltext.tokenize)


def test_vowel_points(index):
    assert fulltext.tokenize("שָׁלוֹם") == ["שלום"] and len(fulltext.tokenize("שָׁלוֹם", strict=True)) == 3


def test_words_prefix_autocomplete_fuzzy(spark, index, chat):
    assert sorted(r.id for r in fulltext.search_words(index, ["WATER", "bill"], every=True).collect()) == [1, 2]
    assert sorted(r.id for r in fulltext.search_words(index, ["storm", "nothing"], every=False).collect()) == [5, 8]
    assert [r.id for r in fulltext.search_prefix(index, "Phot").collect()] == [10]
    keys = spark.createDataFrame([("ann",), ("Anna",), ("annabel",), ("bob",), (None,)], "key string")
    assert [(r.key, r["count"]) for r in fulltext.autocomplete(keys, "AN").collect()] == [("ann", 3), ("anna", 2), ("annabel", 1)]
    rows = chat({"id": 1, "text_plain": "water bill"}, {"id": 2, "text_plain": "water"}, {"id": 3, "text_plain": ""}, {"id": 4})
    assert [r.id for r in fulltext.fuzzy(fulltext.trigram_table(rows), "water bil", 0.3).collect()] == [1, 2]


def test_okapi_negative_idf_and_repeats(chat):
    rows = chat(*[{"id": n, "text_plain": t} for n, t in enumerate(["common word one", "common word two", "common rare thing", "tiny"], 1)])
    found = fulltext.okapi(fulltext.okapi_index(rows), "rare rare common").collect()
    assert found[0].id == 3 and fulltext.okapi(fulltext.okapi_index(rows), "?!").count() == 0


def test_thread_walks(spark, chat):
    rows = chat(*[{"id": n, "reply_to_message_id": p, "text_plain": "long enough text", "date_unixtime": n} for n, p in ((1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 99), (7, 8), (8, 7))])
    nodes = hierarchy(threads.reply_edges(rows))
    assert [r.node_id for r in threads.subtree(nodes, 1).orderBy("place").collect()] == [1, 2, 4, 5, 3]
    assert [r.node_id for r in threads.subtree(nodes, 1).orderBy("depth", "node_id").collect()] == [1, 2, 3, 4, 5]
    assert {r.node_id for r in threads.line_of(nodes, 2).collect()} == {1, 2, 4, 5}
    assert [r.node_id for r in threads.ancestors_of(nodes, 5).orderBy("steps").collect()] == [2, 1]
    assert {(r.root_id, r.n_nodes) for r in threads.components(nodes).collect()} == {(1, 5), (99, 2), (7, 2)}
    found = {r.root_id: (r.n_nodes, r.n_messages) for r in threads.threads(rows, nodes).collect()}
    assert found[99] == (2, 1)
    assert {r.id: r.thread_id for r in threads.thread_map(rows).collect()}[6] is None


def test_components_partition_a_random_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(30)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in threads.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_common_subsequences():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choices("abcשל🚲", k=rng.randrange(12))) for _ in "ab")
        assert similarity.lcs_length(a, b) == slow(a, b) == len(similarity.lcs_string(a, b))
    assert similarity.lcs_similarity("", "x") == 0.0 and similarity.lcs_similarity(None, None) == 0.0


def test_similar_pairs_and_reposts(chat):
    text = "a long sentence about the water bill and the storm of last week"
    rows = chat(*[{"id": n, "from_id": w, "text_plain": t, "date_unixtime": n} for n, w, t in ((1, "a", text), (2, "b", text + "!"), (3, "a", text[:-1]), (4, "c", "x" * 60), (5, "c", None))])
    assert {(r.id_1, r.id_2) for r in similarity.similar_pairs(rows, 0.9).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.id_1, r.id_2) for r in similarity.reposts(rows, 0.9).collect()} == {(1, 2), (2, 3)}
    assert [r.id for r in similarity.similar_to(rows, 1, 0.9).collect()] == [2, 3]
    assert similarity.similar_to(rows, 12345).count() == 0


def test_all_similar_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 60)
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh שלום🚲", k=rng.choice((20, 27, 60, 64, 65, 130, 200)))) for _ in range(100)]
    texts = base + ["".join(c for c in rng.choice(base) if rng.random() > rng.choice((0.02, 0.2, 0.3))) for _ in range(900)] + base[:60] + ["short", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text_plain string")
    pairs, classes = similarity.similar_texts(rows).cache(), similarity.text_classes(rows)
    assert classes.where("class_id > id").count() == 0 and classes.where("id <> class_id").count() >= 60 and pairs.where("class_1 >= class_2").count() == 0
    got = [(r.id_1, r.id_2, r.similarity) for r in similarity.expanded(pairs, classes).collect()]
    other = similarity.similar_pairs(rows.withColumn("from_id", F.col("id") % 2), other_user=True).collect()
    assert {(r.id_1, r.id_2) for r in other} == {(a, b) for a, b, _ in got if (a - b) % 2}
    wanted = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j]
            if a and b and min(len(a), len(b)) >= 20 and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) - 1e-9:
                s = similarity.lcs_similarity(a, b)
                if s >= 0.7:
                    wanted[i, j] = s
    assert len(texts) > similarity.SAMPLE and len(got) == len(wanted) and {(a, b): s for a, b, s in got} == wanted


def test_like_texts_are_left_out_before_their_lcs(monkeypatch):
    """Texts of the same characters in another order: character counts leave out no pair, the bound after a part of the text nearly all."""
    rng, base = random.Random(5), "the water bill before the storm and the old router of the new tenants, as agreed " * 2
    texts = ["".join(rng.sample(base, len(base))) for _ in range(250)]
    texts += [t[:40] + t[60:] for t in texts[:20]]
    whole, compare = [], similarity._side_by_side
    monkeypatch.setattr(similarity, "CALL", 0)
    monkeypatch.setattr(similarity, "_side_by_side", lambda *x: whole.append(len(x[2])) or compare(*x))
    rows = pd.DataFrame({"rep": range(len(texts)), "text": texts})
    found = similarity._compared(rows, None, 0.7)
    assert {tuple(sorted(x)) for x in zip(found.rep_1, found.rep_2)} == {(n, n + 250) for n in range(20)} and len(found) == 20
    assert all(s == similarity.lcs_similarity(texts[a], texts[b]) for a, b, s in found.itertuples(index=False))
    assert 20 <= sum(whole) < 0.1 * len(texts) * (len(texts) - 1) / 2
    parts = similarity._compared(rows[:250], rows[250:], 0.7)
    assert set(zip(parts.rep_1, parts.rep_2)) == {(n, n + 250) for n in range(20)}
    for size in (254, 255, 256, 600):  # around the limits of small numbers and of the buckets
        letters = [chr(0x4E00 + n) for n in range(size)]
        texts = ["".join(rng.sample(letters, size))[:250] for _ in range(40)] + ["".join(letters)]
        texts += [t[:-9] for t in texts[:5]]
        found = similarity._compared(pd.DataFrame({"rep": range(len(texts)), "text": texts}), None, 0.7)
        assert {tuple(sorted(x)) for x in zip(found.rep_1, found.rep_2)} == {(n, n + 41) for n in range(5)}


def test_vectors(spark):
    rows = [(1, "a", [1.0, 0.0], "m"), (2, "b", [0.9, 0.1], "m"), (3, "a", [0.0, 1.0], "m"), (4, "c", [0.0, 0.0], "m"), (5, "c", None, "m"), (6, "c", [float("nan"), 1.0], "m")]
    store = vectors.usable(spark.createDataFrame(rows, "message_id long, from_name string, embedding array<float>, model_name string"), 2)
    assert sorted(r.message_id for r in store.collect()) == [1, 2, 3]
    assert [r.message_id for r in vectors.nearest(store, [1.0, 0.0], "message_id", 2).collect()] == [1, 2]
    assert [r.message_id for r in vectors.similar_messages(store, 1, 1, exclude_same_user=True).collect()] == [2]
    assert vectors.similar_messages(store, 77).count() == 0
    assert vectors.store_stats(store.where("false")).first()["available"] is False
    assert vectors.clusters(store, 2).count() == 3
    coded = vectors.encoded(spark.createDataFrame([(1, "Hello"), (2, None)], "id long, t string"), "t").collect()
    assert len(coded[0].embedding) == 64 and not any(coded[1].embedding)


def test_chunks(chat):
    rows = chat(*[{"id": n, "text_plain": f"message no {n}", "from_name": "A", "date": "2024-01-01T00:00:00", "date_unixtime": n} for n in range(1, 12)])
    got = sorted((r.window_no, r.message_ids, r.anchor_message_id) for r in chunks.sliding_chunks(rows).collect())
    assert got == [(0, [1, 2, 3, 4, 5], 3), (1, [4, 5, 6, 7, 8], 6), (2, [7, 8, 9, 10, 11], 9)]
    thread = chat(*[{"id": n, "text_plain": f"message no {n}", "date_unixtime": n, "reply_to_message_id": n - 1 if n > 1 else None} for n in range(1, 12)], {"id": 50, "text_plain": "lonely text", "date_unixtime": 1})
    found = {(r.chunk_type, r.chunk_no): (r.message_ids, r.anchor_message_id) for r in chunks.thread_chunks(thread).collect()}
    assert found == {("thread", 0): (list(range(1, 11)), 1), ("thread", 1): ([11], 11), ("window", 0): ([50], 50)}


def test_hybrid_search(spark, chat):
    rows = chat(*[{"id": n, "text_plain": t, "date_unixtime": n} for n, t in enumerate(["the storm came", "water everywhere today", "quiet evening again"], 1)])
    store = spark.createDataFrame([(0, [1, 2], "storm and water", [float(x) for x in vectors.hashing_encoder(["storm water"])[0]])], "chunk_id long, message_ids array<long>, text string, embedding array<float>")
    got = hybrid.search(store, fulltext.okapi_index(rows), "storm water").collect()
    assert {r.message_id for r in got} >= {1, 2} and all(abs(r.score - r.vector_score - r.keyword_score) < 1e-9 for r in got)
    assert hybrid.variants("איפה הוא גר")[0] == "איפה הוא גר" and len(hybrid.variants("איפה הוא גר")) == 5 and hybrid.variants("x") == ["x"]


def test_style_features(chat):
    rows = chat({"id": 1, "from_id": "a", "text_plain": "Hi, you... wow!!!", "date": "2024-01-06T03:00:00"}, {"id": 2, "from_id": "a", "text_plain": "ok 2day", "date": "bad"}, {"id": 3, "from_id": "a"})
    r = stylometry.scalar_features(rows).first()
    joined = "Hi, you... wow!!! ok 2day"
    assert abs(r.english_ratio - sum(c.isascii() and c.isalpha() for c in joined) / len(joined)) < 1e-9
    assert (r.period_rate, r.ellipsis_rate, r.leet_speak_rate, r.weekend_ratio, r.night_owl_ratio) == (1.0, 1 / 3, 1 / 3, 1 / 3, 1 / 3)
    assert abs(r.repeated_chars_rate - 1 / 3) < 1e-9 and len(r.hours) == 24 and sum(r.hours) == 1.0
    assert len(stylometry.feature_vector(stylometry.scalar_features(rows)).first()["vector"]) == 77


def test_style_scores():
    assert stylometry.weighted_jaccard({"ab": 0.5, "bc": 0.5}, {"ab": 0.5}) == 0.5 and stylometry.weighted_jaccard({}, {"a": 1}) == 0.0
    assert stylometry.overall(0.97, 0.9, 0.9) == min(1.0, (0.97 * 0.5 + 0.9 * 0.3 + 0.9 * 0.1) * 1.15 * 1.05)
    assert abs(stylometry.overall(0.5, 0.1, 0.0) - (0.25 + 0.03) * 0.5 * 0.85) < 1e-12


def test_many_hits_keep_all_their_neighbours(chat):
    rows = chat(*[{"id": n, "date_unixtime": n // 2, "text_plain": "x"} for n in range(2400)])
    hits = rows.select(F.col("id").alias("hit_id"))
    got = replies.around_many(rows, hits, 1).collect()
    wanted = {(n, n // 2 * 2 - 1, -1) for n in range(2, 2400)} | {(n, n // 2 * 2 + 2, 1) for n in range(2398)}
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    nodes = hierarchy(threads.reply_edges(chat(*[{"id": n, "reply_to_message_id": n + 5000} for n in range(1500)])))
    found = threads.context_of(nodes, nodes.where("depth = 1").select(F.col("node_id").alias("hit_id")))
    assert found.count() == 3000 and found.where("not is_thread_context").count() == 1500


def test_authors_match_brute_force(spark):
    rng = random.Random(2)
    people = []
    for n in range(40):
        base = rng.random()
        grams = lambda: {g: rng.random() for g in rng.sample("abcdefghij", 6)} if rng.random() < 0.95 else {}
        people.append((f"u{n}", [base + 0.2 * rng.random() for _ in range(77)], [rng.random() for _ in range(24)], grams(), grams(), grams()))
    frame = spark.createDataFrame(people, "from_id string, vector array<double>, hours array<double>, bigrams map<string,double>, trigrams map<string,double>, word_bigrams map<string,double>")
    for threshold in (0.5, 0.85):
        wanted = {}
        for i, a in enumerate(people):
            for b in people[i + 1 :]:
                dot = sum(x * y for x, y in zip(a[1], b[1], strict=True)) / (sum(x * x for x in a[1]) * sum(x * x for x in b[1])) ** 0.5
                score = stylometry.overall(dot, stylometry.weighted_jaccard(a[3], b[3]), stylometry.weighted_jaccard(a[4], b[4]))
                if score >= threshold:
                    wanted[min(a[0], b[0]), max(a[0], b[0])] = score
        got = {(r.user_1, r.user_2): r.similarity for r in stylometry.similar_authors(frame, threshold).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert stylometry.least_features(0.85) == 0.94 and stylometry.least_features(2.0) == 2.0


def test_alike_authors_are_found(chat):
    rows = []
    for who, words in (("a", "the water bill is due again"), ("b", "the water bill is due again"), ("c", "ZZZ QQQ!!! 123 456 ???")):
        rows += [{"id": len(rows) + 1, "from_id": who, "text_plain": words, "date": f"2024-01-0{1 + n % 7}T1{n % 9}:00:00", "date_unixtime": n} for n in range(12)]
    found = stylometry.similar_authors(stylometry.profiles(chat(*rows), 10), 0.85).collect()
    assert [(r.user_1, r.user_2) for r in found] == [("a", "b")]
