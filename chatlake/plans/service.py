"""A chat's store with what a search page needs: results cached by query and version, ranks from a stored index, answers from hits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import fulltext, hybrid, vectors
from chatlake.operators.caching import LRUCache
from chatlake.operators.ranking import user_ranks
from chatlake.operators.threads import context_of
from chatlake.plans import questions
from chatlake.sinks.store import Store

CACHED = 256


class ChatService:
    """Questions to one store. Results of bounded length are kept by their arguments and the store's version, so a load makes old ones unreachable."""

    def __init__(self, store: Store, size: int = CACHED) -> None:
        self.store, self.cache = store, LRUCache(size)

    def _kept(self, name: str, arguments: tuple, run: Callable[[], DataFrame]) -> list[dict]:
        key = (name, arguments, self.store.manifest()["version"])
        found = self.cache.get(key)
        if found is None:
            found = [row.asDict(recursive=True) for row in run().collect()]
            self.cache.put(key, found)
        return found

    def search(self, query: str, limit: int = 100, offset: int = 0, newest_first: bool = False) -> list[dict]:
        """id, date_unixtime, from_name, text_plain and score of a page of hits."""
        columns = ("id", "date_unixtime", "from_name", "text_plain", "score")
        return self._kept("search", (query, limit, offset, newest_first), lambda: fulltext.search(self.store.read("messages"), self.store.fulltext(), query, None, limit, offset, newest_first).select(*columns))

    def fuzzy(self, query: str, threshold: float = 0.3, limit: int = 50) -> list[dict]:
        return self._kept("fuzzy", (query, threshold, limit), lambda: fulltext.fuzzy(self.store.read("trigrams"), query, threshold, limit))

    def rank(self, user_id: str) -> list[dict]:
        """Rank and percentile of a member, from the rank table stored for this version."""
        return self._kept("rank", (user_id,), lambda: self._ranks().where(F.col("from_id") == user_id))

    def _ranks(self) -> DataFrame:
        name = f"count_ranks_{self.store.manifest()['numbers'].get('loads', 0)}"
        return self.store.ensure(name, lambda: user_ranks(self.store.read("messages")), ["from_id"])

    def vector_status(self) -> dict:
        """n_vectors, n_models, available; a store without vectors answers too, with none."""
        store = self.store.read("embeddings")
        return {"n_vectors": 0, "n_models": 0, "available": False} if store is None else vectors.store_stats(store).first().asDict()

    def answer_with_search(self, question: str, model: questions.Model, chunks: DataFrame, limit: int = 5, k: int = 2) -> dict:
        """answer and sources from the best hybrid hits, each with its chunk and the messages around it."""
        return answer_from_hits(self.store.read("messages"), chunks, self.store.okapi(), question, model, limit, k)

    def answer_by_meaning(self, question: str, model: questions.Model, limit: int = 30) -> dict:
        return answer_by_meaning(self.store.read("messages"), self.store.read("embeddings"), self.store.read("nodes"), question, model, limit)


def lines_around(messages: DataFrame, hits: DataFrame, k: int, length: int = 100) -> DataFrame:
    """hit_id, position, id, line: each hit (0, whole text) and the messages around it (their first ``length`` characters) as lines for a model."""
    near = hybrid.with_context(messages, hits, k).unionByName(hits.select(F.col("message_id").alias("hit_id"), F.col("message_id").alias("id"), F.lit(0).alias("position")))
    text = F.coalesce("text_plain", F.lit(""))
    line = F.concat(F.lit("["), F.coalesce("date", F.lit("")), F.lit("] "), F.coalesce("from_name", F.lit("?")), F.lit(": "), F.when(F.col("position") == 0, text).otherwise(F.substring(text, 1, length)))
    return near.join(messages.select("id", "date", "from_name", "text_plain"), "id").select("hit_id", "position", "id", line.alias("line"))


def answer_from_hits(messages: DataFrame, chunks: DataFrame, index: fulltext.OkapiIndex, question: str, model: questions.Model, limit: int = 5, k: int = 2, encoder: Callable[[list[str]], np.ndarray] = vectors.hashing_encoder) -> dict:
    """A question answered from the best ``limit`` hybrid hits: answer, sources (message_id, score), or a message that nothing was found."""
    hits = hybrid.search(chunks, index, question, limit, encoder=encoder)
    found = hits.collect()
    if not found:
        return {"answer": None, "sources": [], "error": "nothing found"}
    few = messages.sparkSession.createDataFrame([(r.message_id,) for r in found], "message_id long")
    around = lines_around(messages, few, k).orderBy("hit_id", "position").collect()
    parts = []
    for row in found:
        parts += [f"--- score {row.score:.2f}", *([row.chunk_text] if row.chunk_text else []), *[r.line for r in around if r.hit_id == row.message_id]]
    return {"answer": questions.answer_from_context(question, parts, model), "sources": [{"message_id": r.message_id, "score": r.score} for r in found]}


def thread_context(messages: DataFrame, nodes: DataFrame, hits: DataFrame, levels: int = 3, length: int = 500) -> DataFrame:
    """id, is_thread_context, line: the hits (hit_id) and the messages of their threads, once each; hits outside threads too."""
    placed = context_of(nodes, hits, levels).select(F.col("node_id").alias("id"), "is_thread_context")
    whole = placed.unionByName(hits.select(F.col("hit_id").alias("id"), F.lit(False).alias("is_thread_context"))).groupBy("id").agg(F.min("is_thread_context").alias("is_thread_context"))
    line = F.concat(F.lit("["), F.coalesce("date", F.lit("")), F.lit("] "), F.coalesce("from_name", F.lit("?")), F.lit(": "), F.substring("text_plain", 1, length))
    return whole.join(messages.where("text_plain <> ''").select("id", "date", "from_name", "text_plain"), "id").select("id", "is_thread_context", line.alias("line"))


def semantic_hits(messages: DataFrame, store: DataFrame, question: str, limit: int = 30, encoder: Callable[[list[str]], np.ndarray] = vectors.hashing_encoder) -> DataFrame:
    """The best vector hits with their whole messages: id, score, date, from_name, text_plain."""
    vector = [float(x) for x in encoder([f"query: {question}"])[0]]
    hits = vectors.nearest(vectors.usable(store), vector, "message_id", limit, -1.0).select(F.col("message_id").alias("id"), "score")
    return messages.select("id", "date", "from_name", "text_plain").join(F.broadcast(hits), "id")


def answer_by_meaning(messages: DataFrame, store: DataFrame, nodes: DataFrame, question: str, model: questions.Model, limit: int = 30) -> dict:
    """A question answered from the messages most like it in meaning and their threads: answer, results, total_with_threads."""
    results = [r.asDict() for r in semantic_hits(messages, store, question, limit).orderBy(F.desc("score"), "id").collect()]
    if not results:
        return {"answer": None, "results": [], "error": "nothing found"}
    hits = messages.sparkSession.createDataFrame([(r["id"],) for r in results], "hit_id long")
    lines = [r.line for r in thread_context(messages, nodes, hits).orderBy("id").limit(limit * 50).collect()]
    return {"answer": questions.answer_from_context(question, lines, model), "results": results, "total_with_threads": len(lines)}
