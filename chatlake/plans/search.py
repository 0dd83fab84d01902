"""Queries of the graph, text search, similarity, vector, chunk, hybrid and style operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import jaccard, trigrams
from chatlake.functions.vector import dot, norm, normalised
from chatlake.operators import chunks, fulltext, hybrid, similarity, stylometry, threads, vectors
from chatlake.operators import filters
from chatlake.operators.filters import sampled
from chatlake.operators.hierarchy import ancestors, descendants
from chatlake.plans import questions
from chatlake.plans import service as service_of
from chatlake.plans.problems import KEPT_SQL
from chatlake.plans.service import ChatService
from chatlake.plans.tables import HUB_SQL, USER, chat_store, hub, index, messages, nodes, okapi, participants
from chatlake.plans.tables import trigrams as trigrams_of
from chatlake.session import read_table
from chatlake.sinks import store
from chatlake.sources import chat_export, live_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None, recursive: bool = False) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{KEPT_SQL}{'' if sql.startswith(',') else ' '}{sql}"


def _m(fn):
    return lambda spark, folder: fn(messages(spark, folder))


# Reply graph
_EDGES = ", e AS (SELECT DISTINCT reply_to_message_id AS p, id AS c FROM kept WHERE reply_to_message_id IS NOT NULL)"
_TREE = f"""{_EDGES}, t(node, root, depth, path) AS (SELECT DISTINCT p, p, 0::BIGINT, [p] FROM e WHERE p NOT IN (SELECT c FROM e)
    UNION ALL SELECT c, root, depth + 1, list_append(path, c) FROM t JOIN e ON p = node),
    r(node, above) AS (SELECT c, p FROM e WHERE c NOT IN (SELECT node FROM t) UNION SELECT r.node, p FROM r JOIN e ON c = above),
    loops AS (SELECT node, min(above) AS root FROM r WHERE above IN (SELECT node FROM r WHERE node = above) GROUP BY node),
    nodes AS (SELECT node, root, depth FROM t UNION ALL SELECT node, root, -1 FROM loops), h AS (SELECT {HUB_SQL} AS hub)"""


def _g(fn):
    """A query over the reply links of the kept messages, their hierarchy and the message with the most answers."""

    def run(spark, folder) -> DataFrame:
        rows = messages(spark, folder)
        return fn(rows, nodes(spark, folder), hub(rows))

    return run


def _n(fn):
    """A query over the hierarchy of the reply links of the kept messages."""
    return lambda spark, folder: fn(nodes(spark, folder))


_add("gra1_nodes", _n(lambda n: n.select("node_id", "parent_id")), f"{_TREE} SELECT node AS node_id, (SELECT min(p) FROM e WHERE c = node) AS parent_id FROM nodes", True)
_add("gra2_children", _m(lambda m: threads.children(threads.reply_edges(m), hub(m))), f"{_EDGES} SELECT c AS child_id FROM e WHERE p = {HUB_SQL}")
_add("gra3_parent", _m(lambda m: threads.parent(threads.reply_edges(m), hub(m))), f"{_EDGES} SELECT p AS parent_id FROM e WHERE c = {HUB_SQL}")
_add("gra4_preorder", _g(lambda m, n, h: threads.subtree(n, h).select("node_id", "place")), f"{_TREE} SELECT node AS node_id, row_number() OVER (ORDER BY path) - 1 AS place FROM t, h WHERE list_contains(path, hub)", True)
_add("gra5_levels", _g(lambda m, n, h: threads.subtree(n, h).select("node_id", "depth")), f"{_TREE} SELECT node AS node_id, depth - list_position(path, hub) + 1 AS depth FROM t, h WHERE list_contains(path, hub)", True)
_add("gra6_roots_of_all", _n(lambda n: n.select("node_id", "root_id")), f"{_TREE} SELECT node AS node_id, root AS root_id FROM nodes", True)
_add("gra7_whole_thread", _g(lambda m, n, h: threads.whole_thread(n, h).select("node_id", "depth")), f"{_TREE} SELECT node AS node_id, depth FROM t WHERE root = (SELECT t2.root FROM t t2, h WHERE t2.node = hub)", True)


def _deep(nodes: DataFrame) -> DataFrame:
    """The deepest node; ties by id."""
    return nodes.orderBy(F.desc("depth"), "node_id").limit(1).select("node_id")


_DEEPEST = "(SELECT node FROM t ORDER BY depth DESC, node LIMIT 1)"
_add("gra8_ancestors", _n(lambda n: ancestors(n, _deep(n)).select("ancestor_id", "steps")), f"{_TREE} SELECT unnest(path) AS ancestor_id, len(path) - unnest(range(1, len(path) + 1)) AS steps FROM t WHERE node = {_DEEPEST}".replace("SELECT unnest(path) AS ancestor_id", "SELECT * FROM (SELECT unnest(path) AS ancestor_id") + ") WHERE steps > 0", True)
_add("gra9_path", _n(lambda n: ancestors(n, _deep(n)).select(F.col("ancestor_id").alias("node_id")).unionByName(_deep(n))), f"{_TREE} SELECT unnest(path) AS node_id FROM t WHERE node = {_DEEPEST}", True)
_add("gra4_descendants_of_roots", _n(lambda n: descendants(n, n.where((F.col("depth") == 0) & (F.col("node_id") % 20 == 0))).select("node_id", "descendant_id", "steps")), f"{_TREE} SELECT root AS node_id, node AS descendant_id, depth AS steps FROM t WHERE root % 20 = 0 AND depth > 0", True)
_add("gra10_components", _n(lambda n: threads.components(n).select("root_id", "n_nodes")), f"{_TREE} SELECT root AS root_id, count(*) AS n_nodes FROM nodes GROUP BY root", True)
_add("gra10_undirected", _m(lambda m: threads.connected_components(threads.reply_edges(m).select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")))), f"{_TREE} SELECT node, min(node) OVER (PARTITION BY root) AS component FROM nodes", True)
_add("gra11_thread_roots", _m(lambda m: threads.roots(threads.reply_edges(m))), f"{_EDGES} SELECT DISTINCT p AS node_id FROM e WHERE p NOT IN (SELECT c FROM e)")
_add("gra12_stats", _n(lambda n: threads.graph_stats(n)), f"{_TREE} SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, count(DISTINCT root) AS n_components, max(depth) AS max_depth FROM nodes", True)
_add("gra13_threads", lambda s, d: threads.thread_rows(nodes(s, d)), f"""{_TREE} SELECT root AS root_id, count(*) AS n_nodes, count(kept.id) AS n_messages, max(depth) AS max_depth, min(date_unixtime) AS first_message,
    max(date_unixtime) AS last_message, count(DISTINCT from_id) AS n_participants FROM nodes LEFT JOIN kept ON node = id GROUP BY root""", True)
_add("gra14_thread_messages", _g(lambda m, n, h: threads.whole_thread(n, h).join(m.select(F.col("id").alias("node_id"), "date"), "node_id").select("node_id", "depth", "date")), f"{_TREE} SELECT node AS node_id, depth, date FROM t JOIN kept ON id = node WHERE root = (SELECT t2.root FROM t t2, h WHERE t2.node = hub)", True)
_add("gra15_line", _g(lambda m, n, h: threads.line_of(n, h)), f"{_TREE} SELECT node AS node_id, depth FROM t, h WHERE list_contains(path, hub) OR list_contains((SELECT t2.path FROM t t2, h WHERE t2.node = hub), node)", True)
_add("gra16_context", _g(lambda m, n, h: threads.context_of(n, m.sparkSession.createDataFrame([(h,)], "hit_id long"), 3)), f"{_TREE} SELECT root AS root_id, node AS node_id, depth, node <> hub AS is_thread_context FROM t, h WHERE depth <= 3 AND root = (SELECT t2.root FROM t t2, h WHERE t2.node = hub)", True)
_add("gra17_thread_map", _m(threads.thread_map), """, x AS (SELECT id, reply_to_message_id AS p FROM kept WHERE length(text_plain) > 5), e AS (SELECT p, id AS c FROM x WHERE p IN (SELECT id FROM x)),
    t(node, root) AS (SELECT DISTINCT p, p FROM e WHERE p NOT IN (SELECT c FROM e) UNION ALL SELECT c, root FROM t JOIN e ON p = node),
    r(node, above) AS (SELECT c, p FROM e WHERE c NOT IN (SELECT node FROM t) UNION SELECT r.node, e.p FROM r JOIN e ON c = above),
    loops AS (SELECT node, min(above) AS root FROM r WHERE above IN (SELECT node FROM r WHERE node = above) GROUP BY node)
    SELECT id, root AS thread_id FROM x LEFT JOIN (SELECT * FROM t UNION ALL SELECT * FROM loops) ON id = node""", True)

# Full text
_TOKENS = r"regexp_extract_all(lower(strip_accents({c})), '[\p{{L}}\p{{N}}]+')"
_POST = f""", tok AS (SELECT id, 'text_plain' AS col, {_TOKENS.format(c="coalesce(text_plain, '')")} AS t FROM kept UNION ALL SELECT id, 'from_name', {_TOKENS.format(c="coalesce(from_name, '')")} FROM kept),
    post AS (SELECT id, col, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tok), docs AS (SELECT id, sum(len(t)) AS d FROM tok GROUP BY id),
    total AS (SELECT count(*) AS n_docs, avg(d) AS mean FROM docs)"""


def _f(query: str, **options):
    def run(spark, folder) -> DataFrame:
        return fulltext.match(index(spark, folder), query, **options).select("id", F.round("score", 6).alias("score"))

    return run


def _score(terms: list[str], where: str) -> str:
    leaves = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{_POST}, leaf(leaf, word) AS (VALUES {leaves}), hit AS (SELECT leaf, id, sum(CASE WHEN col = 'text_plain' THEN 1.0 ELSE 0.5 END::DOUBLE) AS f FROM post JOIN leaf ON term = word GROUP BY 1, 2),
    idf AS (SELECT leaf, greatest(ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)), 0) AS raw FROM hit, total GROUP BY leaf, n_docs)
    SELECT id, round(-sum((CASE WHEN raw = 0 THEN 1e-6 ELSE raw END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))), 6) AS score FROM hit JOIN idf USING (leaf) JOIN docs USING (id), total
    GROUP BY id HAVING {where}"""


_add("ftx1_3_and", _f("storm water"), _score(["storm", "water"], "count(*) = 2"))
_add("ftx1_3_or_not", _f("(storm OR playlist) NOT water"), _score(["storm", "playlist", "water"], "max(leaf) < 2"))
_add("ftx1_phrase", lambda s, d: _f('"water bill"')(s, d).select("id"), f"{_POST} SELECT DISTINCT a.id FROM post a JOIN post b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'water' AND b.term = 'bill'")
_add("ftx1_near", lambda s, d: _f("NEAR(volunteers storm, 6)")(s, d).select("id"), f"{_POST} SELECT DISTINCT a.id FROM post a JOIN post b ON a.id = b.id AND a.col = b.col WHERE a.term = 'volunteers' AND b.term = 'storm' AND abs(b.pos - a.pos) - 1 <= 6")
_add("ftx1_column_first", lambda s, d: _f("text_plain : ^ the")(s, d).select("id"), f"{_POST} SELECT id FROM post WHERE col = 'text_plain' AND pos = 0 AND term = 'the'")
_add("ftx6_prefix", lambda s, d: fulltext.search_prefix(index(s, d), "photog"), f"{_POST} SELECT DISTINCT id FROM post WHERE starts_with(term, 'photog')")


def _search(newest: bool):
    def run(spark, folder) -> DataFrame:
        rows = messages(spark, folder)
        return fulltext.search(rows, index(spark, folder), "storm", F.col("has_links") == 0, limit=30, newest_first=newest).select("id")

    return run


_add("ftx4_search", _search(False))
_add("ftx5_search_newest", _search(True), f"{_POST} SELECT id FROM kept WHERE has_links = 0 AND id IN (SELECT id FROM post WHERE term = 'storm') ORDER BY date_unixtime DESC, id LIMIT 30")
_add("ftx7_fallback", lambda s, d: fulltext.keyword_fallback(messages(s, d), index(s, d), "is the storm or playlist").select("id"), f"{_POST} SELECT id FROM kept WHERE id IN (SELECT id FROM post WHERE term IN ('the', 'storm', 'playlist')) ORDER BY date_unixtime DESC, id LIMIT 20")
_add("ftx8_9_every_word", lambda s, d: fulltext.search_words(index(s, d), ["Storm", "bill"], every=True), f"{_POST} SELECT id FROM post WHERE term IN ('storm', 'bill') GROUP BY id HAVING count(DISTINCT term) = 2")
_add("ftx10_any_word", lambda s, d: fulltext.search_words(index(s, d), ["storm", "bill"], every=False), f"{_POST} SELECT DISTINCT id FROM post WHERE term IN ('storm', 'bill')")
_add("ftx11_14_autocomplete", lambda s, d: (lambda p: fulltext.autocomplete(p.select(F.col("first_name").alias("key")).unionByName(p.select(F.col("username").alias("key"))), "ve"))(participants(s, d)), """, keys AS (SELECT lower(k) AS key FROM (SELECT first_name AS k FROM participants UNION ALL SELECT username FROM participants) WHERE k IS NOT NULL)
    SELECT a.key, count(*) AS count FROM (SELECT DISTINCT key FROM keys WHERE starts_with(key, 've')) a JOIN keys b ON starts_with(b.key, a.key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
_TRI = "list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substr({c}, i, 3)))"
_CLEAN = r"lower(regexp_replace(text_plain, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
_add("ftx15_16_fuzzy", lambda s, d: fulltext.fuzzy(trigrams_of(s, d), "the water bill before the storm", 0.3).select("id", F.round("similarity", 6).alias("similarity")), f""", x AS (SELECT id, {_CLEAN} AS c FROM kept WHERE text_plain IS NOT NULL), s AS (SELECT id, {_TRI.format(c="c")} AS t FROM x WHERE length(c) >= 3),
    q AS (SELECT {_TRI.format(c="'the water bill before the storm'")} AS t), j AS (SELECT id, len(list_intersect(s.t, q.t)) / len(list_distinct(list_concat(s.t, q.t))) AS similarity FROM s, q)
    SELECT id, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.3 ORDER BY j.similarity DESC, id LIMIT 50""")
_add("ftx17_trigram_table", lambda s, d: trigrams_of(s, d).groupBy("trigram").agg(F.count("*").alias("n")), f", x AS (SELECT id, {_CLEAN} AS c FROM kept WHERE text_plain IS NOT NULL), s AS (SELECT CASE WHEN length(c) >= 3 THEN {_TRI.format(c='c')} WHEN c <> '' THEN [c] ELSE [] END AS t FROM x) SELECT trigram, count(*) AS n FROM (SELECT unnest(t) AS trigram FROM s) GROUP BY 1")
_add("ftx18_first_words", lambda s, d: fulltext.first_words_alike(messages(s, d), index(s, d), 500020).select("id"))
_add("hyb3_okapi", lambda s, d: fulltext.okapi(okapi(s, d), "storm water storm", 30).select("id", F.round("score", 6).alias("score")), r""", w AS (SELECT id, regexp_extract_all(lower(text_plain), '[\p{L}\p{N}\p{M}_\x{200C}\x{200D}]+') AS t FROM kept WHERE length(text_plain) > 5), docs AS (SELECT id, len(t) AS d FROM w), total AS (SELECT count(*) AS n_docs, avg(d) AS mean FROM docs),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM w) GROUP BY 1, 2), idf AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, total GROUP BY term, n_docs),
    q(term, times) AS (VALUES ('storm', 2), ('water', 1))
    SELECT id, round(sum(times * (CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * d / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN docs USING (id), total
    GROUP BY id HAVING score > 0 ORDER BY sum(times * (CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * d / mean))) DESC, id LIMIT 30""")

# Similar texts
_add("sim1_2_trigram_similarity", _m(lambda m: m.select("id", F.round(jaccard(trigrams(F.col("text_plain")), trigrams(F.lit("the water bill before the storm"))), 6).alias("similarity"))), f""", x AS (SELECT id, {_CLEAN} AS c FROM kept), s AS (SELECT id, CASE WHEN length(c) >= 3 THEN {_TRI.format(c="c")} WHEN c <> '' THEN [c] ELSE [] END AS t FROM x), q AS (SELECT {_TRI.format(c="'the water bill before the storm'")} AS t)
    SELECT id, round(CASE WHEN len(s.t) = 0 THEN 0 ELSE len(list_intersect(s.t, q.t)) / len(list_distinct(list_concat(s.t, q.t))) END, 6) AS similarity FROM s, q""")
_add("sim6_7_similar_sample", _m(lambda m: similarity.with_previews(similarity.similar_pairs(sampled(m.where(F.length("text_plain") >= 30), 1000), 0.7, 30), m)))
_add("sim6_similar_texts", _m(similarity.similar_texts))
_add("sim6_text_classes", _m(similarity.text_classes), "SELECT id, min(id) OVER (PARTITION BY text_plain) AS class_id FROM kept WHERE length(text_plain) >= 20")
_add("sim8_reposts", _m(lambda m: similarity.reposts(m, 0.9)))


def _copied(rows: DataFrame) -> int:
    """The first message whose text, of 30 to 80 characters, another one has too; ties by id."""
    found = rows.where("length(text_plain) between 30 and 80").groupBy("text_plain").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").agg(F.min("id")).first()
    return found[0] if found[0] is not None else -1


_add("sim9_similar_to", _m(lambda m: similarity.similar_to(m, _copied(m)).select("id", F.round("similarity", 6).alias("similarity"))), """, q AS (SELECT text_plain AS q, id AS qid FROM kept WHERE id = (SELECT min(id) FROM (SELECT min(id) AS id FROM kept WHERE length(text_plain) BETWEEN 30 AND 80 GROUP BY text_plain HAVING count(*) > 1))),
    x AS (SELECT id, text_plain AS t, string_split(q, '') AS a, length(q) AS n, greatest(length(q), length(text_plain)) AS longest FROM kept, q WHERE id <> qid AND length(text_plain) > 20 AND least(length(q), length(text_plain)) >= 0.7 * greatest(length(q), length(text_plain)) - 1e-9),
    y AS (SELECT id, longest, list_reduce(string_split(t, ''), lambda row, c: list_reduce(list_transform(range(1, n + 1), lambda i: CASE WHEN a[i] = c THEN row[i] + 1 ELSE row[i + 1] END), lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0::BIGINT]), list_transform(range(n + 1), lambda i: 0)) AS r FROM x)
    SELECT id, round(r[-1] / longest, 6) AS similarity FROM y WHERE r[-1] / longest >= 0.7 ORDER BY r[-1] / longest DESC, id LIMIT 10""")
_add("sim10_all_similar", _m(lambda m: similarity.similar_pairs(sampled(m.where(F.length("text_plain") > 30), 500, seed=1), 0.8, 31).orderBy(F.desc("similarity"), "id_1", "id_2").limit(50)))

# Vectors
_Q = "[" + ", ".join(f"{((i * 37) % 17 - 8) / 10}" for i in range(64)) + "]"
_QUERY = json.loads(_Q)


def _v(fn):
    return lambda spark, folder: fn(read_table(spark, folder, "embeddings"))


_add("sca15_vector_math", _v(lambda v: v.select("vec_id", F.round(dot("embedding", F.array(*[F.lit(x) for x in _QUERY])), 4).alias("dot"), F.round(norm("embedding"), 4).alias("norm"), F.round(norm(normalised("embedding")), 4).alias("unit"))), f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_Q}), 4) AS dot, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
_add("vec3_nearest", _v(lambda v: vectors.nearest(v, _QUERY, "vec_id", 10, 0.1).select("vec_id", F.round("score", 5).alias("score"))), f"SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10")


def _store(spark, folder) -> DataFrame:
    return vectors.usable(read_table(spark, folder, "message_embeddings")).dropDuplicates(["message_id"])


_add("vec2_usable", lambda s, d: _store(s, d).select("message_id", "model_name"), "SELECT DISTINCT message_id, model_name FROM message_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
_add("vec4_similar_messages", lambda s, d: (lambda v: vectors.similar_messages(v, v.agg(F.min("message_id")).first()[0]).select("message_id", F.round("score", 5).alias("score")))(_store(s, d)), """, u AS (SELECT message_id, any_value(model_name) AS model, any_value(embedding::DOUBLE[]) AS v FROM message_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
    q AS (SELECT * FROM u ORDER BY message_id LIMIT 1), b AS (SELECT u.message_id, list_cosine_similarity(u.v, q.v) AS s FROM u, q WHERE u.model = q.model ORDER BY 2 DESC, 1 LIMIT 20)
    SELECT message_id, round(s, 5) AS score FROM b WHERE message_id NOT IN (SELECT message_id FROM q) ORDER BY s DESC, 1 LIMIT 10""")
_add("vec5_clusters", lambda s, d: vectors.clusters(_store(s, d)))
_add("vec6_7_text_search", lambda s, d: vectors.nearest(vectors.encoded(messages(s, d).where(F.length("text_plain") > 10).select("id", "text_plain"), "text_plain", prefix="passage: "), [float(x) for x in vectors.hashing_encoder(["query: the water bill before the storm"])[0]], "id", 20, 0.3).select("id", "score"))
_add("vec8_stats", lambda s, d: vectors.store_stats(read_table(s, d, "message_embeddings")), "SELECT count(*) AS n_vectors, count(DISTINCT model_name) AS n_models, count(*) > 0 AS available FROM message_embeddings")
_add("ded4_missing_vectors", lambda s, d: vectors.missing(messages(s, d), read_table(s, d, "message_embeddings")).select("message_id", "text_preview"), "SELECT id AS message_id, substr(text_plain, 1, 100) AS text_preview FROM kept WHERE length(trim(text_plain)) > 10 AND id NOT IN (SELECT message_id FROM message_embeddings)")

# Chunks and hybrid search
_add("chk1_sliding", _m(lambda m: chunks.sliding_chunks(m).select("window_no", "anchor_message_id", F.array_join("message_ids", ",").alias("ids"), F.md5("text").alias("text"))), """, x AS (SELECT *, row_number() OVER (ORDER BY date_unixtime, id) - 1 AS nth, '[' || coalesce(from_name, '') || ', ' || substr(coalesce(date, ''), 1, 16) || '] ' || substr(text_plain, 1, 200) AS line FROM kept WHERE length(text_plain) > 5),
    w AS (SELECT w.w AS window_no, x.* FROM x, LATERAL (SELECT unnest(range(greatest(0, (nth - 2) // 3), nth // 3 + 1)) AS w) w WHERE nth >= w.w * 3 AND nth < w.w * 3 + 5)
    SELECT window_no, list(id ORDER BY nth)[3] AS anchor_message_id, string_agg(id::VARCHAR, ',' ORDER BY nth) AS ids, md5(string_agg(line, chr(10) ORDER BY nth)) AS text FROM w GROUP BY 1 HAVING count(*) = 5""")
_add("chk2_thread_chunks", _m(lambda m: chunks.thread_chunks(m).select("chunk_type", "thread_id", "chunk_no", "anchor_message_id", F.array_join("message_ids", ",").alias("ids"))))
_add("src9_read_chunks", lambda s, d: chunks.read_chunks(read_table(s, d, "chunk_embeddings")).select("chunk_id", "chunk_type", F.size("message_ids").cast("long").alias("n")), "SELECT chunk_id, coalesce(chunk_type, 'window') AS chunk_type, json_array_length(message_ids)::BIGINT AS n FROM chunk_embeddings")
_add("joi12_chunk_messages", lambda s, d: chunks.read_chunks(read_table(s, d, "chunk_embeddings")).select("chunk_id", F.explode("message_ids").alias("message_id")), "SELECT chunk_id, unnest(from_json(message_ids, '[\"BIGINT\"]')) AS message_id FROM chunk_embeddings")


def _chunks(spark, folder) -> DataFrame:
    return vectors.usable(chunks.read_chunks(read_table(spark, folder, "chunk_embeddings")))


_add("hyb2_chunk_search", lambda s, d: vectors.nearest(_chunks(s, d), _QUERY, "chunk_id", 20, -1.0).select("chunk_id", F.round("score", 5).alias("score")), f"SELECT chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM (SELECT * FROM chunk_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, chunk_id LIMIT 20")
_add("hyb5_hybrid", lambda s, d: hybrid.search(_chunks(s, d), okapi(s, d), "storm water").select("message_id", F.round("score", 6).alias("score"), F.md5("chunk_text").alias("chunk_text")))
_add("hyb6_with_context", lambda s, d: hybrid.with_context(messages(s, d), hybrid.search(_chunks(s, d), okapi(s, d), "storm water", 5)))
_add("hyb7_status", lambda s, d: hybrid.status(_chunks(s, d), _store(s, d), okapi(s, d)))

# Styles
def _style(rows: DataFrame) -> DataFrame:
    names = ("avg_message_length", "std_message_length", "hebrew_ratio", "comma_rate", "question_rate", "short_message_ratio", "avg_words_per_message", "avg_word_length")
    return stylometry.scalar_features(rows).select("from_id", "n_messages", *[F.round(c, 6).alias(c) for c in names])


_add("sty1_6_features", _m(_style), r""", x AS (SELECT from_id, coalesce(text_plain, '') AS t, list_filter(regexp_split_to_array(coalesce(text_plain, ''), '[\p{Z}\s\x{85}\x{1C}-\x{1F}\v]+'), lambda w: w <> '') AS w FROM kept WHERE from_id <> '')
    SELECT from_id, count(*) AS n_messages, round(coalesce(avg(length(t)) FILTER (t <> ''), 0), 6) AS avg_message_length, round(coalesce(stddev_pop(length(t)) FILTER (t <> ''), 0), 6) AS std_message_length,
    round(CASE WHEN sum(length(t)) > 0 THEN sum(len(regexp_extract_all(t, '[\x{0590}-\x{05FF}]'))) / (sum(length(t)) + count(*) FILTER (t <> '') - 1) ELSE 0 END, 6) AS hebrew_ratio,
    round(sum(len(regexp_extract_all(t, ','))) / count(*), 6) AS comma_rate, round(sum(len(regexp_extract_all(t, '\?'))) / count(*), 6) AS question_rate,
    round(coalesce(sum(CASE WHEN len(w) < 5 AND t <> '' THEN 1 ELSE 0 END), 0) / count(*), 6) AS short_message_ratio, round(coalesce(avg(len(w)) FILTER (t <> ''), 0), 6) AS avg_words_per_message,
    round(CASE WHEN sum(len(w)) > 0 THEN sum(list_sum(list_transform(w, lambda v: length(v)))) / sum(len(w)) ELSE 0 END, 6) AS avg_word_length FROM x GROUP BY 1""")
_add("sty7_8_features", _m(lambda m: stylometry.scalar_features(m).select("from_id", *[F.round(c, 6).alias(c) for c in ("unique_word_ratio", "hapax_ratio", "leet_speak_rate", "slang_rate", "acronym_rate", "formality_score", "long_message_ratio", "punctuation_ratio", "english_ratio")])))
_add("sty9_bigrams", _m(lambda m: stylometry.ngrams(m.where("text_plain <> ''"), "bigrams").select("from_id", "gram", F.round("share", 8).alias("share"))))
_add("sty9_word_bigrams", _m(lambda m: stylometry.ngrams(m.where("text_plain <> ''"), "word_bigrams").select("from_id", "gram", F.round("share", 8).alias("share"))))
_add("sty10_samples", _m(lambda m: stylometry.style_samples(m).select("from_id", F.length("text").alias("n"), F.md5("text").alias("text"))))
_add("sty11_vectors", _m(lambda m: stylometry.feature_vector(stylometry.scalar_features(m)).select("from_id", F.size("vector").alias("n"), *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in (0, 1, 2, 3, 4, 9, 11)])))
_add("sty13_15_similar_authors", _m(lambda m: stylometry.similar_authors(stylometry.profiles(m, 100), 0.5)))
_add("sty14_clusters", _m(lambda m: stylometry.clusters(stylometry.profiles(m, 30), 0.7)))


def _explained(rows: DataFrame) -> DataFrame:
    found = stylometry.profiles(rows, 100)
    return stylometry.explained(stylometry.similar_authors(found, 0.5), found).select("user_1", "user_2", "shared")


_add("sty16_explained", _m(_explained))

# Sources, exports and the question surface
_raw = lambda s, d: read_table(s, d, "messages").where("raw_json is not null").select(F.try_parse_json("raw_json").alias("message")).where("message is not null")
_add("src4_5_parse", lambda s, d: chat_export.parsed(_raw(s, d)).select("id", "type", "from_name", "text_plain", F.col("text_length").cast("long").alias("text_length"), "date_unixtime", "has_media"), """SELECT (raw_json ->> 'id')::BIGINT AS id, raw_json ->> 'type' AS type, coalesce(raw_json ->> 'from', '') AS from_name, coalesce(raw_json ->> 'text', '') AS text_plain,
    length(coalesce(raw_json ->> 'text', '')) AS text_length, 0::BIGINT AS date_unixtime, 0 AS has_media FROM messages WHERE raw_json IS NOT NULL""")
_add("src16_sample", _m(lambda m: sampled(m, 100).select("id")))
_add("src17_probe", _m(lambda m: chat_export.probe(m)), "SELECT id, date, from_name, substr(text_plain, 1, 80) AS text FROM kept ORDER BY date_unixtime DESC, id LIMIT 50")
_add("snk2_unseen", lambda s, d: store.unseen(messages(s, d).select("id"), read_table(s, d, "message_embeddings").select(F.col("message_id").alias("id")), "id"), "SELECT id FROM kept WHERE id NOT IN (SELECT message_id FROM message_embeddings WHERE message_id IS NOT NULL)")
_add("snk14_users_export", _m(store.users_export), "SELECT from_id, max(from_name) AS name, count(*) AS messages, coalesce(sum(text_length), 0)::BIGINT AS characters, coalesce(sum(has_links), 0)::BIGINT AS links, coalesce(sum(has_media), 0)::BIGINT AS media, strftime(make_timestamp(min(date_unixtime) * 1000000), '%Y-%m-%dT%H:%M:%S') AS first_message, strftime(make_timestamp(max(date_unixtime) * 1000000), '%Y-%m-%dT%H:%M:%S') AS last_message FROM kept WHERE from_id IS NOT NULL GROUP BY 1")
_add("snk15_messages_export", _m(lambda m: store.messages_export(m, 1000).select("id", "text")), "SELECT id, substr(text_plain, 1, 500) AS text FROM kept ORDER BY date_unixtime DESC, id LIMIT 1000")
_add("snk16_json", _m(lambda m: store.as_json(m.select("id", "from_id"))), "SELECT '{' || concat_ws(',', '\"id\":' || id, '\"from_id\":' || to_json(from_id)) || '}' AS json FROM kept")


def _nlq3_gate(spark, folder) -> DataFrame:
    rows = messages(spark, folder)
    rows.createOrReplaceTempView("chat_messages")
    answer = "```sql\nWITH busy AS (SELECT from_id, count(*) AS n FROM chat_messages GROUP BY from_id) SELECT from_id, n FROM busy WHERE n > 50;\n```"
    return questions.gate(spark, questions.extract_sql(answer), ["chat_messages"])


_add("nlq3_4_gate", _nlq3_gate, "SELECT from_id, count(*) AS n FROM kept GROUP BY from_id HAVING count(*) > 50")
_add("nlq6_retrieve", lambda s, d: questions.retrieve(messages(s, d), index(s, d), "Kolbra", ["storm", "bill"]).select("id", "source"))



# More SQL for queries above
_add("hyb4_single_vectors", lambda s, d: vectors.nearest(_store(s, d), _QUERY, "message_id", 20, -1.0).select("message_id", F.round("score", 5).alias("score")), f""", u AS (SELECT message_id, any_value(embedding::DOUBLE[]) AS v FROM message_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)
    SELECT message_id, round(list_cosine_similarity(v, {_Q}), 5) AS score FROM u ORDER BY list_cosine_similarity(v, {_Q}) DESC, message_id LIMIT 20""")
SQL["ftx4_search"] = f"WITH {KEPT_SQL}{_score(['storm'], 'true')}".replace("SELECT id, round(-sum(", "SELECT id FROM (SELECT id, (-sum(").replace(", 6) AS score FROM hit", ") AS score FROM hit") + ") JOIN kept USING (id) WHERE has_links = 0 ORDER BY round(score, 9), id LIMIT 30"
SQL["hyb7_status"] = f"""WITH {KEPT_SQL}, ok AS (SELECT 1 AS x, chunk_id AS k FROM chunk_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    UNION ALL SELECT DISTINCT 2, message_id FROM message_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
    SELECT count(*) FILTER (x = 1) AS n_chunks, count(*) FILTER (x = 2) AS n_vectors, (SELECT count(*) FROM kept WHERE length(text_plain) > 5) AS n_documents, count(*) FILTER (x = 1) > 0 AS has_chunks, count(*) FILTER (x = 2) > 0 AS has_vectors, true AS has_documents FROM ok"""
_WORDS = r"list_filter(regexp_split_to_array(lower(text_plain), '[\p{Z}\s\x{85}\x{1C}-\x{1F}\v]+'), lambda w: w <> '')"
SQL["sty9_word_bigrams"] = f"""WITH {KEPT_SQL}, w AS (SELECT from_id, {_WORDS} AS w FROM kept WHERE from_id <> '' AND text_plain <> ''), g AS (SELECT from_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w),
    c AS (SELECT from_id, gram, count(*) AS n FROM g GROUP BY 1, 2) SELECT from_id, gram, round(share, 8) AS share FROM (SELECT from_id, gram, n / sum(n) OVER (PARTITION BY from_id) AS share, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, gram) AS nth FROM c) WHERE nth <= 50"""
SQL["sty9_bigrams"] = f"""WITH {KEPT_SQL}, w AS (SELECT from_id, regexp_replace(lower(text_plain), '[\\p{{Z}}\\s\\x{{85}}\\x{{1C}}-\\x{{1F}}\\v]+', ' ', 'g') AS t FROM kept WHERE from_id <> '' AND text_plain <> ''), g AS (SELECT from_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS gram FROM w),
    c AS (SELECT from_id, gram, count(*) AS n FROM g WHERE trim(gram) <> '' GROUP BY 1, 2) SELECT from_id, gram, round(share, 8) AS share FROM (SELECT from_id, gram, n / sum(n) OVER (PARTITION BY from_id) AS share, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, gram) AS nth FROM c) WHERE nth <= 100"""
SQL["sty10_samples"] = f"""WITH {KEPT_SQL}, x AS (SELECT from_id, text_plain, row_number() OVER (PARTITION BY from_id ORDER BY date_unixtime, id) AS nth FROM kept WHERE text_plain <> '')
    SELECT from_id, least(5000, sum(length(text_plain)) + count(*) - 1)::INTEGER AS n FROM x WHERE nth <= 100 GROUP BY 1"""
SQL["sty11_vectors"] = f"WITH {KEPT_SQL} SELECT DISTINCT from_id, 77 AS n FROM kept WHERE from_id <> ''"

# SQL of the fixed-text searches and of the style features
_TERMS = r"regexp_extract_all(lower(strip_accents(array_to_string(list_filter(regexp_split_to_array(text_plain, '[\p{Z}\s]+'), lambda w: w <> '')[1:5], ' '))), '[\p{L}\p{N}]+')"
SQL["ftx18_first_words"] = f"WITH {KEPT_SQL}{_POST}, w AS (SELECT unnest({_TERMS}) AS term FROM kept WHERE id = 500020) SELECT id FROM kept WHERE id <> 500020 AND id IN (SELECT id FROM post WHERE term IN (SELECT term FROM w)) ORDER BY date_unixtime DESC, id LIMIT 10"
SQL["nlq6_retrieve"] = f"""WITH {KEPT_SQL}{_POST}, u AS (SELECT * FROM kept WHERE contains(lower(from_name), 'kolbra')),
    k AS (SELECT * FROM u WHERE id IN (SELECT id FROM post WHERE term IN ('storm', 'bill')) ORDER BY date_unixtime DESC, id LIMIT 100), r AS (SELECT * FROM u ORDER BY date_unixtime DESC, id LIMIT 50),
    b AS (SELECT id, text_plain, date_unixtime, 0 AS source FROM k UNION ALL SELECT id, text_plain, date_unixtime, 1 FROM r)
    SELECT id, source FROM b QUALIFY row_number() OVER (PARTITION BY text_plain ORDER BY source, date_unixtime DESC, id) = 1"""
_CHUNKS_OK = "(SELECT * FROM chunk_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_STORM = "[" + ", ".join(repr(float(x)) for x in vectors.hashing_encoder(["storm water"])[0]) + "]"
_HYBRID = rf""", cv AS (SELECT chunk_id, text, message_ids, list_cosine_similarity(embedding::DOUBLE[], {_STORM}) AS s FROM {_CHUNKS_OK} ORDER BY s DESC, chunk_id LIMIT 40),
    vm AS (SELECT unnest(from_json(message_ids, '["BIGINT"]')) AS message_id, 0.6 * s AS v, text FROM cv),
    w AS (SELECT id, regexp_extract_all(lower(text_plain), '[\p{{L}}\p{{N}}\p{{M}}_\x{{200C}}\x{{200D}}]+') AS t FROM kept WHERE length(text_plain) > 5), docs AS (SELECT id, len(t) AS d FROM w), total AS (SELECT count(*) AS n_docs, avg(d) AS mean FROM docs),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM w) GROUP BY 1, 2), idf AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, total GROUP BY term, n_docs),
    bm AS (SELECT id, sum((CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * d / mean))) AS s FROM tf JOIN idf USING (term) JOIN docs USING (id), total WHERE term IN ('storm', 'water') GROUP BY id HAVING s > 0 ORDER BY s DESC, id LIMIT 40),
    both_ AS (SELECT message_id, v, 0 AS k, text FROM vm UNION ALL SELECT id, 0, 0.04 * s, NULL FROM bm),
    best AS (SELECT message_id, greatest(0, max(v)) + greatest(0, max(k)) AS score, first(text ORDER BY v DESC, text) FILTER (text IS NOT NULL) AS chunk_text FROM both_ GROUP BY 1)"""
SQL["hyb5_hybrid"] = f"WITH {KEPT_SQL}{_HYBRID} SELECT message_id, round(score, 6) AS score, md5(chunk_text) AS chunk_text FROM best ORDER BY best.score DESC, message_id LIMIT 20"
SQL["hyb6_with_context"] = f"""WITH {KEPT_SQL}{_HYBRID.replace("LIMIT 40", "LIMIT 10")}, h AS (SELECT message_id FROM best ORDER BY score DESC, message_id LIMIT 5), t AS (SELECT id AS hit_id, date_unixtime AS mark FROM kept JOIN h ON id = message_id),
    b AS (SELECT hit_id, id, -row_number() OVER (PARTITION BY hit_id ORDER BY date_unixtime DESC, id DESC) AS position FROM t JOIN kept ON date_unixtime < mark QUALIFY position >= -3),
    a AS (SELECT hit_id, id, row_number() OVER (PARTITION BY hit_id ORDER BY date_unixtime, id) AS position FROM t JOIN kept ON date_unixtime > mark QUALIFY position <= 3) SELECT * FROM b UNION ALL SELECT * FROM a"""
SQL["chk2_thread_chunks"] = SQL["gra17_thread_map"].replace("SELECT id, root AS thread_id FROM x LEFT JOIN", """, m AS (SELECT id, root AS thread_id FROM x LEFT JOIN""") + """), o AS (SELECT m.id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY date_unixtime, m.id) - 1 AS nth FROM m JOIN kept USING (id)),
    p AS (SELECT thread_id, nth // 10 AS chunk_no, list(id ORDER BY nth) AS ids FROM o WHERE thread_id IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT w.w AS chunk_no, list(id ORDER BY nth) AS ids FROM o, LATERAL (SELECT unnest(range(greatest(0, (nth - 2) // 3), nth // 3 + 1)) AS w) w WHERE thread_id IS NULL AND nth >= w.w * 3 AND nth < w.w * 3 + 5 GROUP BY 1 HAVING count(*) = 5)
    SELECT 'thread' AS chunk_type, thread_id, chunk_no, ids[1] AS anchor_message_id, array_to_string(ids, ',') AS ids FROM p UNION ALL SELECT 'window', NULL, chunk_no, ids[3], array_to_string(ids, ',') FROM w"""


def _listed(parts: list[str]) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in parts) + "]"


_STYLE = rf""", x AS (SELECT from_id, coalesce(text_plain, '') AS t, list_filter(regexp_split_to_array(coalesce(text_plain, ''), '[\p{{Z}}\s\x{{85}}\x{{1C}}-\x{{1F}}\v]+'), lambda w: w <> '') AS w FROM kept WHERE from_id <> ''),
    u AS (SELECT from_id, word, count(*) AS n FROM (SELECT from_id, unnest(list_transform(w, lambda v: lower(v))) AS word FROM x) GROUP BY 1, 2), v AS (SELECT from_id, count(*) AS distinct_, count(*) FILTER (n = 1) AS hapax FROM u GROUP BY 1),
    fm AS (SELECT from_id, count(DISTINCT p) AS formal FROM (SELECT from_id, unnest(list_filter({_listed(stylometry.FORMAL)}, lambda p: contains(t, p))) AS p FROM x) GROUP BY 1),
    fi AS (SELECT from_id, count(DISTINCT p) AS informal FROM (SELECT from_id, unnest(list_filter({_listed(stylometry.INFORMAL)}, lambda p: contains(lower(t), p))) AS p FROM x) GROUP BY 1),
    g AS (SELECT from_id, count(*) AS n, sum(length(t)) AS chars, sum(length(t)) + greatest(count(*) FILTER (t <> '') - 1, 0) AS total, greatest(1, sum(len(w))) AS words, sum(len(w)) AS raw_words, avg(length(t)) FILTER (t <> '') AS mean_length, stddev_pop(length(t)) FILTER (t <> '') AS sd_length, avg(len(w)) FILTER (t <> '') AS mean_words,
        sum(list_sum(list_transform(w, lambda v: length(v)))) AS word_chars, sum(len(regexp_extract_all(t, '[\x{{0590}}-\x{{05FF}}]'))) AS hebrew, sum(len(regexp_extract_all(t, '[a-zA-Z]'))) AS english, sum(len(regexp_extract_all(t, '[.,!?;:()\[\]{{}}]'))) AS punct,
        sum(len(regexp_extract_all(t, ','))) AS comma, sum(len(regexp_extract_all(t, '\?'))) AS question, sum(len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda y: regexp_matches(y, '\p{{Nd}}')))) AS leet,
        sum(len(list_filter({_listed(stylometry.SLANG)}, lambda p: contains(t, p)))) AS slang, sum(len(list_filter({_listed(stylometry.ACRONYMS)}, lambda p: contains(t, p)))) AS acronym, sum(CASE WHEN len(w) > 30 THEN 1 ELSE 0 END) AS long FROM x GROUP BY 1)"""
SQL["sty7_8_features"] = f"""WITH {KEPT_SQL}{_STYLE} SELECT g.from_id, round(coalesce(distinct_, 0) / words, 6) AS unique_word_ratio, round(coalesce(hapax, 0) / greatest(1, coalesce(distinct_, 0)), 6) AS hapax_ratio, round(leet / n, 6) AS leet_speak_rate, round(slang / n, 6) AS slang_rate, round(acronym / n, 6) AS acronym_rate,
    round(CASE WHEN coalesce(formal, 0) + coalesce(informal, 0) > 0 THEN (coalesce(formal, 0) - coalesce(informal, 0)) / (coalesce(formal, 0) + coalesce(informal, 0)) ELSE 0 END, 6) AS formality_score, round(long / n, 6) AS long_message_ratio,
    round(CASE WHEN total > 0 THEN punct / total ELSE 0 END, 6) AS punctuation_ratio, round(CASE WHEN total > 0 THEN english / total ELSE 0 END, 6) AS english_ratio FROM g LEFT JOIN v USING (from_id) LEFT JOIN fm USING (from_id) LEFT JOIN fi USING (from_id)"""
SQL["sty11_vectors"] = f"""WITH {KEPT_SQL}{_STYLE} SELECT from_id, 77 AS n, round(coalesce(mean_length, 0) / 200, 6) AS v0, round(coalesce(sd_length, 0) / 100, 6) AS v1, round(CASE WHEN raw_words > 0 THEN word_chars / raw_words ELSE 0 END / 10, 6) AS v2, round(coalesce(mean_words, 0) / 20, 6) AS v3,
    round(CASE WHEN total > 0 THEN hebrew / total ELSE 0 END, 6) AS v4, round(comma / n / 2, 6) AS v9, round(question / n, 6) AS v11 FROM g"""
SQL["sty10_samples"] = f"""WITH {KEPT_SQL}, x AS (SELECT from_id, text_plain, row_number() OVER (PARTITION BY from_id ORDER BY date_unixtime, id) AS nth FROM kept WHERE text_plain <> ''),
    y AS (SELECT from_id, substr(string_agg(text_plain, ' ' ORDER BY nth), 1, 5000) AS t FROM x WHERE nth <= 100 GROUP BY 1) SELECT from_id, length(t)::INTEGER AS n, md5(t) AS text FROM y"""


# The live source, cached searches, and what a model is given
def _live(spark, folder) -> DataFrame:
    """Live rows as a client would list them, made of the kept messages."""
    rows = messages(spark, folder)
    number = F.regexp_extract("from_id", r"(\d+)$", 1).cast("bigint")
    person = F.col("from_id").startswith("user")
    none = F.lit(None).cast("string")
    sender = F.when(F.col("from_id") != "", F.struct(number.alias("id"), F.when(person, F.coalesce("from_name", F.lit(""))).alias("first_name"), F.when(person, F.lit("")).alias("last_name"), F.when(~person, F.coalesce("from_name", F.lit(""))).alias("title")))
    link = F.regexp_instr("text_plain", F.lit(r"https?://\S+"))
    entity = F.when(link > 0, F.array(F.struct(F.lit("url").alias("kind"), (link - 1).alias("start"), F.length(F.regexp_extract("text_plain", r"https?://\S+", 0)).alias("length"), none.alias("url"))))
    forward = F.when(F.col("forwarded_from").isNotNull(), F.struct(F.lit(None).cast("struct<id:bigint,first_name:string,last_name:string,title:string>").alias("sender"), F.col("forwarded_from").alias("name")))
    photo = F.when(F.col("has_photo") == 1, F.struct(F.col("photo_width").alias("width"), F.col("photo_height").alias("height")))
    return rows.select("id", F.col("text_plain").alias("text"), "date_unixtime", F.when(F.col("is_edited") == 1, F.col("edited_unixtime")).alias("edited_unixtime"), F.col("reply_to_message_id").alias("reply_to"), entity.alias("entities"), sender.alias("sender"), forward.alias("forward"), photo.alias("photo"), (F.col("has_media") == 1).alias("has_file"))


_add("src13_live_messages", lambda s, d: live_rows.live_messages(_live(s, d)).select("id", "date", "from_name", "from_id", "reply_to_message_id", "forwarded_from", F.md5("text_plain").alias("text"), "has_media", "has_photo", "has_links", F.size("entities").alias("n_entities")), r"""SELECT id, strftime(make_timestamp(coalesce(date_unixtime, 0) * 1000000), '%Y-%m-%dT%H:%M:%S') AS date, CASE WHEN from_id <> '' THEN regexp_replace(coalesce(from_name, ''), '^[\p{Z}\s]+|[\p{Z}\s]+$', '', 'g') ELSE '' END AS from_name,
    coalesce(from_id, '') AS from_id, CASE WHEN reply_to_message_id <> 0 THEN reply_to_message_id END AS reply_to_message_id, forwarded_from, md5(text_plain) AS text, CASE WHEN has_media = 1 OR has_photo = 1 THEN 1 ELSE 0 END AS has_media, CASE WHEN has_photo = 1 THEN 1 ELSE 0 END AS has_photo,
    CASE WHEN regexp_matches(text_plain, 'https?://\S+') THEN 1 ELSE 0 END AS has_links, CASE WHEN regexp_matches(text_plain, 'https?://\S+') THEN 1 ELSE 0 END AS n_entities FROM kept WHERE regexp_matches(text_plain, '[^\p{Z}\s\x{85}\x{1C}-\x{1F}\v]')""")
_add("src14_live_members", lambda s, d: live_rows.live_participants(participants(s, d).select(F.regexp_extract("user_id", r"(\d+)$", 1).cast("bigint").alias("id"), "first_name", "last_name", "username", "phone", (F.col("is_bot") == 1).alias("is_bot"), (F.col("is_premium") == 1).alias("is_premium"), F.when(F.col("is_creator") == 1, "creator").when(F.col("is_admin") == 1, "admin").alias("role"), F.col("join_date").alias("joined"), F.col("last_status").alias("status"), F.col("last_online").alias("seen")), 1_700_000_000).select("user_id", "first_name", "is_admin", "is_creator", "last_status", "last_online"),
    "SELECT 'user' || regexp_extract(user_id, '(\\d+)$', 1) AS user_id, coalesce(first_name, '') AS first_name, CASE WHEN is_admin = 1 OR is_creator = 1 THEN 1 ELSE 0 END AS is_admin, CASE WHEN is_creator = 1 THEN 1 ELSE 0 END AS is_creator, coalesce(last_status, 'unknown') AS last_status, CASE last_status WHEN 'online' THEN 1700000000 WHEN 'offline' THEN last_online END::BIGINT AS last_online FROM participants")


def _cached_search(spark, folder) -> DataFrame:
    """The page a second, equal search gets from the cache."""
    index(spark, folder), messages(spark, folder)
    service = ChatService(chat_store(spark, folder))
    service.search("storm", 30)
    rows = service.search("storm", 30)
    if service.cache.hits != 1:
        raise AssertionError("the second search wasn't answered from the cache")
    return spark.createDataFrame([(r["id"],) for r in rows], "id long")


_add("cac3_cached_search", _cached_search)
SQL["cac3_cached_search"] = SQL["ftx4_search"].replace("WHERE has_links = 0 ", "")
_add("rnk11_cached_rank", lambda s, d: (lambda rows: s.createDataFrame([(r["from_id"], r["message_count"], r["rank"]) for r in rows], "from_id string, message_count long, rank long"))((messages(s, d), ChatService(chat_store(s, d)).rank(USER))[1]), f"SELECT * FROM (SELECT from_id, count(*) AS message_count, dense_rank() OVER (ORDER BY count(*) DESC) AS rank FROM kept WHERE from_id <> '' GROUP BY 1) WHERE from_id = '{USER}'")
_add("fil2_chat_search", lambda s, d: filters.chat_view(messages(s, d), filters.chat_matching(has_media="0"), fulltext.match(index(s, d), "storm")).select("id"), f"{_POST} SELECT id FROM kept WHERE has_media = 0 AND id IN (SELECT id FROM post WHERE term = 'storm')")


def _newest_hits(spark, folder) -> DataFrame:
    return fulltext.search(messages(spark, folder), index(spark, folder), "storm", None, 20, newest_first=True).select(F.col("id").alias("hit_id"))


_HITS20 = f"{_POST}, h AS (SELECT id AS hit FROM kept WHERE id IN (SELECT id FROM post WHERE term = 'storm') ORDER BY date_unixtime DESC, id LIMIT 20)"
_add("nlq8_lines_around", lambda s, d: service_of.lines_around(messages(s, d), _newest_hits(s, d).toDF("message_id"), 2).select("hit_id", "position", "id", F.md5("line").alias("line")), f"""{_HITS20}, t AS (SELECT id AS hit_id, date_unixtime AS mark FROM kept JOIN h ON id = hit),
    b AS (SELECT hit_id, id, -row_number() OVER (PARTITION BY hit_id ORDER BY date_unixtime DESC, id DESC) AS position FROM t JOIN kept ON date_unixtime < mark QUALIFY position >= -2),
    a AS (SELECT hit_id, id, row_number() OVER (PARTITION BY hit_id ORDER BY date_unixtime, id) AS position FROM t JOIN kept ON date_unixtime > mark QUALIFY position <= 2), c AS (SELECT * FROM b UNION ALL SELECT * FROM a UNION ALL SELECT hit, hit, 0 FROM h)
    SELECT hit_id, position::INTEGER AS position, id, md5('[' || coalesce(date, '') || '] ' || coalesce(from_name, '?') || ': ' || CASE WHEN position = 0 THEN coalesce(text_plain, '') ELSE substr(coalesce(text_plain, ''), 1, 100) END) AS line FROM c JOIN kept USING (id)""")
_add("nlq9_thread_context", lambda s, d: service_of.thread_context(messages(s, d), nodes(s, d), _newest_hits(s, d)).select("id", "is_thread_context"), f"""{_TREE}{_HITS20.replace(", h AS", ", hh AS")}, c AS (SELECT node AS id, true AS ctx FROM t WHERE depth <= 3 AND root IN (SELECT t2.root FROM nodes t2 JOIN hh ON t2.node = hit) UNION ALL SELECT hit, false FROM hh)
    SELECT id, bool_and(ctx) AS is_thread_context FROM c WHERE id IN (SELECT id FROM kept WHERE text_plain <> '') GROUP BY 1""", True)


def _exported(rows: DataFrame) -> DataFrame:
    """The kept messages as an export writes them, texts as lists of pieces."""
    piece = F.array(F.struct(F.lit("bold").alias("type"), F.col("text_plain").alias("text")))
    found = F.array_compact(F.array(F.when(F.col("has_links") == 1, F.struct(F.lit("link").alias("type"), F.lit("https://x").alias("text"))), F.when(F.col("has_mentions") == 1, F.struct(F.lit("mention").alias("type"), F.lit("@x").alias("text")))))
    fields = [
        F.col("id"), F.lit("message").alias("type"), F.col("date"), F.col("date_unixtime").cast("string").alias("date_unixtime"), F.col("from_name").alias("from"), F.col("from_id"), F.col("reply_to_message_id"),
        piece.alias("text"), found.alias("text_entities"), F.when(F.col("has_photo") == 1, "p.jpg").alias("photo"), F.when(F.col("has_media") == 1, "video").alias("media_type"), F.when(F.col("is_edited") == 1, "yes").alias("edited"),
    ]
    return rows.select(F.parse_json(F.to_json(F.struct(*fields))).alias("message"))


_add("src4_5_parse_all", _m(lambda m: chat_export.parsed(_exported(m)).select("id", "date", "date_unixtime", "from_name", "from_id", "reply_to_message_id", F.md5("text_plain").alias("text"), F.col("text_length").cast("long").alias("text_length"), "has_media", "has_photo", "has_links", "has_mentions", "is_edited", F.size("entities").alias("n_entities"))), """SELECT id, date, coalesce(date_unixtime, 0) AS date_unixtime, coalesce(from_name, '') AS from_name, coalesce(from_id, '') AS from_id, reply_to_message_id, md5(coalesce(text_plain, '')) AS text, length(coalesce(text_plain, '')) AS text_length,
    CASE WHEN has_media = 1 OR has_photo = 1 THEN 1 ELSE 0 END AS has_media, CASE WHEN has_photo = 1 THEN 1 ELSE 0 END AS has_photo, CASE WHEN has_links = 1 THEN 1 ELSE 0 END AS has_links, CASE WHEN has_mentions = 1 THEN 1 ELSE 0 END AS has_mentions, CASE WHEN is_edited = 1 THEN 1 ELSE 0 END AS is_edited,
    CASE WHEN has_links = 1 THEN 1 ELSE 0 END + CASE WHEN has_mentions = 1 THEN 1 ELSE 0 END AS n_entities FROM kept""")
_add("vec7_full_text", lambda s, d: service_of.semantic_hits(messages(s, d), _store(s, d), "", 20, lambda texts: [_QUERY]).select("id", F.round("score", 5).alias("score"), F.md5("text_plain").alias("text")), f""", u AS (SELECT message_id, any_value(embedding::DOUBLE[]) AS v FROM message_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
    b AS (SELECT message_id, list_cosine_similarity(v, {_Q}) AS s FROM u ORDER BY s DESC, message_id LIMIT 20) SELECT id, round(s, 5) AS score, md5(text_plain) AS text FROM b JOIN kept ON id = message_id""")


# Similar texts in SQL: characters in common bound the candidates, whose longest common subsequences come from rows of the table
def _alike(source: str, threshold: float, apart: str = "true") -> str:
    """Pairs id_1 < id_2 of the texts (id, from_id, t) of ``source`` at the threshold."""
    rows = "SELECT id_1, id_2, longest, list_reduce(string_split(t, ''), lambda row, c: list_reduce(list_transform(range(1, n + 1), lambda i: CASE WHEN a[i] = c THEN row[i] + 1 ELSE row[i + 1] END), lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0::BIGINT]), list_transform(range(n + 1), lambda i: 0::BIGINT)) AS r"  # in 16 parts, which run side by side
    return f"""{source}, ch AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(t, '')) AS c FROM s) GROUP BY 1, 2),
    near AS (SELECT a.id AS id_1, b.id AS id_2, sum(least(a.n, b.n)) AS common FROM ch a JOIN ch b ON a.c = b.c AND a.id < b.id GROUP BY 1, 2),
    x AS MATERIALIZED (SELECT id_1, id_2, string_split(p.t, '') AS a, q.t AS t, length(p.t) AS n, greatest(length(p.t), length(q.t)) AS longest FROM near JOIN s p ON p.id = id_1 JOIN s q ON q.id = id_2 WHERE common >= {threshold} * greatest(length(p.t), length(q.t)) - 1e-9 AND {apart}),
    y AS ({" UNION ALL ".join(f"{rows} FROM x WHERE (id_1 + id_2) % 16 = {part}" for part in range(16))}),
    found AS (SELECT id_1, id_2, r[-1] / longest AS similarity FROM y WHERE r[-1] / longest >= {threshold})"""


_PLACE = "md5('{seed}:' || id)"
SQL["src16_sample"] = f"WITH {KEPT_SQL} SELECT id FROM kept ORDER BY {_PLACE.format(seed=0)}, id LIMIT 100"
SQL["sim8_reposts"] = f"WITH {KEPT_SQL}{_alike(', s AS (SELECT id, from_id, text_plain AS t FROM kept WHERE length(text_plain) >= 50 ORDER BY date_unixtime DESC, id LIMIT 500)', 0.9, 'p.from_id IS DISTINCT FROM q.from_id')} SELECT * FROM found"
SQL["sim10_all_similar"] = f"WITH {KEPT_SQL}{_alike(', s AS (SELECT id, from_id, text_plain AS t FROM kept WHERE length(text_plain) > 30 ORDER BY ' + _PLACE.format(seed=1) + ', id LIMIT 500)', 0.8)} SELECT * FROM found ORDER BY similarity DESC, id_1, id_2 LIMIT 50"
SQL["sim6_7_similar_sample"] = f"WITH {KEPT_SQL}{_alike(', s AS (SELECT id, from_id, text_plain AS t FROM kept WHERE length(text_plain) >= 30 ORDER BY ' + _PLACE.format(seed=0) + ', id LIMIT 1000)', 0.7)} SELECT found.*, substr(p.text_plain, 1, 100) AS text_1, substr(q.text_plain, 1, 100) AS text_2 FROM found JOIN kept p ON p.id = id_1 JOIN kept q ON q.id = id_2"
