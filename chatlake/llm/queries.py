"""Queries of the language-model operators over a data folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.conversations import conversations
from chatlake.llm.language import language_segments, wrong_labels
from chatlake.llm.leakage import leaked_passages, without_leaks
from chatlake.llm.mixing import mixed, share_report
from chatlake.llm.neighbours import similar_pairs
from chatlake.llm.pii import known_names, personal_data, redacted
from chatlake.llm.sentences import sentences
from chatlake.plans.problems import KEPT_SQL
from chatlake.session import read_table

SURROGATE_KEY = "chatlake-demo-key"
"""Key of the surrogates in the demonstration query; a real job passes its own secret."""


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(read_table(spark, folder, "messages")).select("root_id", "turn_no", "message_id")


def p1_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(read_table(spark, folder, "messages")).select("root_id", "turn_no", "message_id", "role", "from_id", "date_unixtime")


def p1_in_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found with small queues and every round of the links between them distributed, as a table too large for one task's remainder runs."""
    return conversations(read_table(spark, folder, "messages"), queue_rows=500, local_rows=0).select("root_id", "turn_no", "message_id")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Both stores of vectors as space (store/model), key, embedding."""
    messages = read_table(spark, folder, "message_embeddings").select(F.concat(F.lit("message/"), F.coalesce("model_name", F.lit(""))).alias("space"), F.col("message_id").alias("key"), "embedding")
    chunks = read_table(spark, folder, "chunk_embeddings").select(F.lit("chunk/").alias("space"), F.col("chunk_id").alias("key"), "embedding")
    return messages.unionByName(chunks)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "message_embeddings").count() + read_table(spark, folder, "chunk_embeddings").count()
    pairs = similar_pairs(_vectors(spark, folder), rows)
    return pairs.select(F.split("space", "/")[0].alias("store"), "key_a", "key_b")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    messages = read_table(spark, folder, "messages").select(F.lit("messages.text_plain").alias("field"), F.col("delivery_id").cast("string").alias("record_key"), F.col("text_plain").alias("text"))
    people = read_table(spark, folder, "participants")
    fields = [people.select(F.lit(f"participants.{c}").alias("field"), F.col("user_id").alias("record_key"), F.col(c).alias("text")) for c in ("phone", "about")]
    return messages.unionByName(fields[0]).unionByName(fields[1])


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return personal_data(texts, known_names(read_table(spark, folder, "participants"), texts))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).select("field", "record_key", "kind", "nth")


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(_texts(spark, folder), p3_pieces(spark, folder), SURROGATE_KEY)


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language_segments(read_table(spark, folder, "messages").select("delivery_id", "text_plain", "lang", "from_name"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return wrong_labels(p6_segments(spark, folder)).select("delivery_id", "segment_no", "lang")


def p8_longest(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_longest(spark, folder).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "source", "lang")


def p9_mixed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(read_table(spark, folder, "documents"), read_table(spark, folder, "source_targets"))


def p9_share_report(spark: SparkSession, folder: str) -> DataFrame:
    return share_report(p9_mixed_documents(spark, folder), read_table(spark, folder, "source_targets"), read_table(spark, folder, "documents"))


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(read_table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_sentences(spark, folder).select("doc_id", "start_pos", "end_pos")


QUERIES = {
    "p1_found": p1_found, "p1_conversations": p1_conversations, "p1_in_rounds": p1_in_rounds, "p2_found": p2_found, "p3_found": p3_found, "p3_redacted": p3_redacted,
    "p6_found": p6_found, "p6_segments": p6_segments, "p8_found": p8_found, "p8_longest": p8_longest, "p8_clean": p8_clean,
    "p9_mixed_documents": p9_mixed_documents, "p9_share_report": p9_share_report, "p10_found": p10_found, "p10_sentences": p10_sentences,
}

_CONVERSATIONS = f"""WITH RECURSIVE {KEPT_SQL}, m AS (
    SELECT id, reply_to_message_id AS parent, coalesce(date_unixtime, 0) AS date, coalesce(from_id, '') AS sender,
        coalesce(regexp_matches(text_plain, '[^\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]'), false) AS shown FROM kept WHERE id IS NOT NULL),
members AS (
    SELECT id, id AS root, date, sender, shown, date = 0 OR sender = '' AS flaw FROM m WHERE parent IS NULL
    UNION ALL SELECT m.id, p.root, m.date, m.sender, m.shown, m.date = 0 OR m.sender = '' OR m.date < p.date FROM members p JOIN m ON m.parent = p.id),
whole AS (
    SELECT root, max(sender) FILTER (id = root) AS opener FROM members GROUP BY root
    HAVING count(*) > 1 AND NOT bool_or(flaw) AND bool_or(shown AND id = root)
        AND (min(sender) FILTER (shown) <> max(sender) FILTER (id = root) OR max(sender) FILTER (shown) <> max(sender) FILTER (id = root))),
turns AS (
    SELECT root AS root_id, row_number() OVER (PARTITION BY root ORDER BY date, id) AS turn_no, id AS message_id,
        CASE WHEN sender = opener THEN 'opener' ELSE 'answerer' END AS role, sender AS from_id, date AS date_unixtime
    FROM members JOIN whole USING (root) WHERE shown)"""

SQL = {
    "p1_found": f"{_CONVERSATIONS} SELECT root_id, turn_no, message_id FROM turns",
    "p1_in_rounds": f"{_CONVERSATIONS} SELECT root_id, turn_no, message_id FROM turns",
    "p1_conversations": f"{_CONVERSATIONS} SELECT * FROM turns",
    "p2_found": """WITH stored AS (
        SELECT 'message' AS store, message_id AS key, coalesce(model_name, '') AS model, embedding FROM message_embeddings
        UNION ALL SELECT 'chunk', chunk_id, '', embedding FROM chunk_embeddings),
    usable AS (
        SELECT store, key, any_value(model) AS model, any_value(embedding::DOUBLE[64]) AS v FROM stored
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY store, key),
    pairs AS (
        SELECT a.store, a.key AS me, b.key AS other, array_cosine_similarity(a.v, b.v) AS s
        FROM usable a JOIN usable b ON a.store = b.store AND a.model = b.model AND a.key <> b.key),
    near AS (SELECT *, row_number() OVER (PARTITION BY store, me ORDER BY s DESC, other) AS nth FROM pairs QUALIFY nth <= 5)
    SELECT DISTINCT store, least(me, other) AS key_a, greatest(me, other) AS key_b FROM near WHERE s >= 0.9""",
}

# Letters and digits of full width and the plain ones they stand for.
_WIDE, _PLAIN = ("".join(chr(c + shift) for first, last in (("0", "9"), ("A", "Z"), ("a", "z")) for c in range(ord(first), ord(last) + 1)) for shift in (0xFEE0, 0))
_WORDS = f"regexp_extract_all(regexp_replace(lower(strip_accents(translate(text, '{_WIDE}', '{_PLAIN}'))), '[\\p{{M}}\\p{{Cf}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
    dw AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 11], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
    iw AS (SELECT DISTINCT item_id, hash(array_to_string(w[k:k + 11], ' ')) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
    found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (h))"""
SQL["p8_found"] = f"{_LEAKS} SELECT doc_id, item_id FROM found"
SQL["p8_clean"] = f"{_LEAKS} SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)"
SQL["p8_longest"] = _LEAKS.replace("DISTINCT doc_id, hash", "doc_id, k, hash").replace("DISTINCT item_id, hash", "item_id, k, hash") + """,
    pairs AS (SELECT DISTINCT doc_id, item_id, dw.k AS a, dw.k - iw.k AS way FROM dw JOIN iw USING (h)), runs AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, way ORDER BY a) AS run FROM pairs),
    whole AS (SELECT doc_id, item_id, count(*) + 11 AS n_words, min(a) - 1 AS word_pos FROM runs GROUP BY doc_id, item_id, way, run)
    SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, word_pos) = 1"""
