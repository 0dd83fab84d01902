"""Sets of names looked up by the words of texts: sent to every task while small, joined by their words beyond that."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARED_WORDS = 16_000_000
"""Largest set that is sent to every task (8 bytes a word); the words of a larger one are joined with those of the texts."""


def fingerprint(word: str) -> int:
    """The 64-bit print that Spark's ``xxhash64`` gives a string."""
    value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
    return value - (1 << 64) if value >> 63 else value


class Words:
    """Sorted prints of a set of words. Two words share a print with a chance of 2**-64, so even among 10 million a wrong hit comes once in 10**12 questions."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = np.sort(np.asarray(prints, np.int64))

    def __len__(self) -> int:
        return len(self.prints)

    def __contains__(self, mark: int) -> bool:
        at = int(np.searchsorted(self.prints, mark))
        return at < len(self.prints) and int(self.prints[at]) == mark

    def among(self, words: Iterable[str]) -> np.ndarray:
        """Whether each word is in the set."""
        marks = np.fromiter(map(fingerprint, words), np.int64)
        if not len(self.prints):
            return np.zeros(len(marks), bool)
        return self.prints[np.minimum(np.searchsorted(self.prints, marks), len(self.prints) - 1)] == marks


def word_set(words: DataFrame, column: str = "word", limit: int = SHARED_WORDS) -> Words | DataFrame:
    """The distinct prints of a column of words: in memory up to ``limit`` of them, otherwise as a table (print)."""
    from chatlake.session import settle

    prints = settle(words.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("print")).distinct())
    if prints.count() > limit:
        return prints
    return Words(prints.toArrow().column("print").to_numpy())


def with_known(texts: DataFrame, column: str, marks_of: Callable[[str], Iterable[int]], words: DataFrame) -> DataFrame:
    """``texts`` with ``known``: the prints of ``words`` among those ``marks_of`` gives for the text. The way for sets too large to send.

    Texts meet the set by their words and come back by two prints of the text; equal texts count once.
    """

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(set(marks_of(text))) for text in batch["text"]]
            counts = [len(f) for f in found]
            yield pd.DataFrame({"one": np.repeat(batch.one.to_numpy(), counts), "two": np.repeat(batch.two.to_numpy(), counts), "print": np.array([m for f in found for m in f], np.int64)})

    named = texts.withColumns({"__one": F.xxhash64(column), "__two": F.xxhash64(F.lit(1), F.col(column))})
    asked = named.where(F.col(column).isNotNull()).select(F.col("__one").alias("one"), F.col("__two").alias("two"), F.col(column).alias("text")).mapInPandas(marks, "one long, two long, print long")
    known = asked.distinct().join(words, "print").groupBy(F.col("one").alias("__one"), F.col("two").alias("__two")).agg(F.collect_set("print").alias("known"))
    return named.join(known, ["__one", "__two"], "left").drop("__one", "__two")
