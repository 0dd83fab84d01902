"""Hybrid ranking: chunk vectors and keyword scores combined per message."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.fulltext import OkapiIndex, okapi_many
from chatlake.operators.replies import around_many
from chatlake.operators.vectors import hashing_encoder, nearest
from chatlake.operators.running import beside

# Question words and what they may be replaced by.
SYNONYMS = {
    "איפה": ["איפה", "היכן", "מיקום", "כתובת", "עיר"],
    "מתי": ["מתי", "באיזה תאריך", "מועד", "זמן"],
    "מי": ["מי", "מיהו", "מיהי", "שם"],
    "כמה": ["כמה", "מספר", "כמות"],
    "למה": ["למה", "מדוע", "סיבה"],
    "גר": ["גר", "גרה", "מתגורר", "מתגוררת", "גרים"],
    "עובד": ["עובד", "עובדת", "עובדים", "מועסק", "עבודה"],
}


def variants(query: str, most: int = 5) -> list[str]:
    """The query, then its distinct rewritings by one synonym, in the order of the table."""
    rewritten = (query.replace(word, other) for word, others in SYNONYMS.items() if word in query for other in others if other != word)
    return list(dict.fromkeys([query, *rewritten]))[:most]


def search(chunks: DataFrame, index: OkapiIndex, query: str, limit: int = 20, vector_weight: float = 0.6, keyword_weight: float = 0.4, expand: bool = True, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder) -> DataFrame:
    """message_id, vector_score, keyword_score, score, chunk_text of the best messages.

    For each variant of the query the best chunks (their score goes to each of their messages) and the best keyword hits, twice
    the limit each; per message the best of either kind, weighted; keyword scores count a tenth. Ties by message_id.
    """
    asked = variants(query) if expand else [query]
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    parts = []
    for number, text in enumerate(asked):
        vector = [float(x) for x in encoder([text])[0]]
        hits = nearest(chunks, vector, "chunk_id", 2 * limit, -1.0)
        parts.append(hits.select(F.explode("message_ids").alias("message_id"), (F.col("score") * vector_weight).alias("vector_score"), zero.alias("keyword_score"), F.col("text").alias("chunk_text"), F.lit(number).alias("variant")))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    words = okapi_many(index, asked).withColumn("nth", nth).where(F.col("nth") <= 2 * limit)
    parts.append(words.select(F.col("id").alias("message_id"), zero.alias("vector_score"), (F.col("score") * keyword_weight / 10).alias("keyword_score"), none.alias("chunk_text"), F.col("query").alias("variant")))
    best = reduce(DataFrame.unionByName, parts).groupBy("message_id").agg(
        F.greatest(zero, F.max("vector_score")).alias("vector_score"), F.greatest(zero, F.max("keyword_score")).alias("keyword_score"),
        F.min_by("chunk_text", F.when(F.col("chunk_text").isNotNull(), F.struct("variant", -F.col("vector_score"), "chunk_text"))).alias("chunk_text"),
    )
    return best.withColumn("score", F.col("vector_score") + F.col("keyword_score")).orderBy(F.desc("score"), "message_id").limit(limit)


def with_context(messages: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """For each hit (message_id) the k messages before and after it in time: hit_id, id, position."""
    return around_many(messages, hits.select(F.col("message_id").alias("hit_id")), k)


def status(chunks: DataFrame, vectors: DataFrame, index: OkapiIndex) -> DataFrame:
    """One row: numbers of chunks, vectors and keyword documents, and whether each is available."""
    counts = [chunks.agg(F.count("*").alias("n_chunks")), vectors.agg(F.count("*").alias("n_vectors")), index.documents.agg(F.count("*").alias("n_documents"))]
    row = reduce(lambda a, b: a.transform(beside, b), counts)
    return row.select("*", *[(F.col(c) > 0).alias(f"has_{c[2:]}") for c in row.columns])
