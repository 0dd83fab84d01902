"""Vector stores: reading, encoding, exact search and clustering."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions.vector import cosine

DIMENSION = 64


def hashing_encoder(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors of hashed words and their character trigrams: a stand-in encoder without weights, the same everywhere."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            for piece in (word, *(f"_{word}_"[i : i + 3] for i in range(len(word)))):
                code = zlib.crc32(piece.encode("utf-8", "replace"))
                out[row, code % dimension] += 1 if code >> 16 & 1 else -1
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1)


def encoded(rows: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, prefix: str = "", cut: int | None = None, model: str = "hashing-64") -> DataFrame:
    """The rows with embedding and model_name; texts go to the encoder in Arrow batches, null texts as empty."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [prefix + (t or "")[:cut] for t in batch[text]]
            yield batch.assign(embedding=list(encoder(texts)), model_name=model)

    columns = ", ".join(f"`{c}` {kind}" for c, kind in rows.drop("embedding", "model_name").dtypes)
    return rows.drop("embedding", "model_name").mapInPandas(encode, f"{columns}, embedding array<float>, model_name string")


def usable(store: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Rows whose vector has the dimension, finite numbers only and not all 0."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return store.where((F.size("embedding") == dimension) & finite & F.exists("embedding", lambda x: x != 0))


def missing(messages: DataFrame, store: DataFrame, min_length: int = 10) -> DataFrame:
    """Messages with longer texts that the store has no vector of, with text (500 characters) and text_preview (100)."""
    rows = messages.where(F.length(F.trim("text_plain")) > min_length).join(store.select(F.col("message_id").alias("id")), "id", "left_anti")
    return rows.select(F.col("id").alias("message_id"), "from_name", F.substring("text_plain", 1, 500).alias("text"), F.substring("text_plain", 1, 100).alias("text_preview"))


def nearest(store: DataFrame, query: list[float], key: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """Rows of a usable store most similar to one vector: twice the limit by similarity, then those of at least ``min_score``, then the limit. Ties by key.

    The query vector is part of the expression; each task keeps its own best rows.
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = store.withColumn("score", cosine(F.col("embedding"), wanted))
    return scored.orderBy(F.desc("score"), key).limit(2 * limit).where(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(limit)


def similar_messages(store: DataFrame, message_id: int, limit: int = 10, exclude_same_user: bool = False) -> DataFrame:
    """The messages most similar to one: of the best twice ``limit`` without itself (and without its sender), so possibly fewer; none if it has no vector."""
    own = store.where(F.col("message_id") == message_id).select("embedding", "from_name", "model_name").orderBy("model_name").first()
    if own is None:
        return store.where(F.lit(False)).withColumn("score", F.lit(0.0))
    best = nearest(store.where(F.col("model_name") == own["model_name"]), list(own["embedding"]), "message_id", 2 * limit, -1.0).limit(2 * limit)
    rest = best.where(F.col("message_id") != message_id)
    if exclude_same_user:
        rest = rest.where(~F.col("from_name").eqNullSafe(own["from_name"]))
    return rest.orderBy(F.desc("score"), "message_id").limit(limit)


def clusters(store: DataFrame, k: int = 10, iterations: int = 20, seed: int = 1) -> DataFrame:
    """message_id, cluster by k-means over the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = store.select("message_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed, predictionCol="cluster").fit(rows)
    return model.transform(rows).select("message_id", "cluster")


def store_stats(store: DataFrame) -> DataFrame:
    """n_vectors, models, available; a missing or empty store is not available."""
    return store.agg(F.count("*").alias("n_vectors"), F.countDistinct("model_name").alias("n_models"), (F.count("*") > 0).alias("available"))
