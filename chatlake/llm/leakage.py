"""Held-out passages inside training documents, found by suffix arrays over the corpus shards."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
ITEM_BYTES = 32_000_000
"""Test texts are sent to the executors in slices of about this size, one after the other."""
SHARD_WORDS = 2_000_000
"""Words of one suffix array; a document is never cut."""

_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after compatibility decomposition, without case, combining marks and format characters."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


def _windows(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` codes from each start as fixed-length byte strings whose order is the order of the suffixes."""
    view = np.lib.stride_tricks.sliding_window_view(codes, width)[starts]
    return np.ascontiguousarray(view.astype(">u4")).view(f"S{4 * width}").ravel()


def _full_starts(codes: np.ndarray, width: int) -> np.ndarray:
    """Starts of ``width`` codes without a 0."""
    if len(codes) < width:
        return np.empty(0, np.int64)
    zeros = np.concatenate([[0], np.cumsum(codes == 0)])
    return np.flatnonzero(zeros[width:] == zeros[:-width])


class TestSuffixes:
    """The suffixes of the test items of at least ``width`` words, over the items' own vocabulary (codes from 1)."""

    __test__ = False

    def __init__(self, ids: list, texts: list[str | None], width: int) -> None:
        self.width = width
        self.vocabulary: dict[str, int] = {}
        codes, owners = [], []
        for at, text in enumerate(texts):
            for word in words_of(text):
                codes.append(self.vocabulary.setdefault(word, len(self.vocabulary) + 1))
                owners.append(at)
            codes.append(0)
            owners.append(at)
        self.ids = ids
        self.codes, self.owners = np.array(codes, np.int64), np.array(owners, np.int64)
        self.starts = _full_starts(self.codes, width)
        self.keys = _windows(self.codes, self.starts, width) if len(self.starts) else np.empty(0, f"S{4 * width}")

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corpus position, test position and length of each common run that can't be longer to the left, to its full length.

        Builds the suffix array of the shard over the suffixes that can match (all words known to the test items), sorted by
        their first words and then by the word before them, and looks every test suffix up in it by binary search. Of the
        suffixes found, those with the same word before are passed over unexpanded: they are part of a run that begins earlier.
        """
        starts = _full_starts(codes, self.width)
        none = np.empty(0, np.int64)
        if not len(starts) or not len(self.starts):
            return none, none, none
        before = np.where(starts > 0, codes[starts - 1], 0)
        keys = _windows(codes, starts, self.width)
        order = np.lexsort((before, keys))
        array, keys, before = starts[order], keys[order], before[order]
        test_before = np.where(self.starts > 0, self.codes[self.starts - 1], 0)
        low, high = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.keys, "right")
        both = _pair(keys, before)
        skip_low, skip_high = np.searchsorted(both, _pair(self.keys, test_before), "left"), np.searchsorted(both, _pair(self.keys, test_before), "right")
        free = test_before == 0
        skip_low, skip_high = np.where(free, high, skip_low), np.where(free, high, skip_high)
        parts = [(array[at], self.starts[owner]) for at, owner in (_expanded(low, skip_low), _expanded(skip_high, high))]
        corpus, test = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if not len(corpus):
            return none, none, none
        return corpus, test, self._lengths(codes, corpus, test)

    def _lengths(self, codes: np.ndarray, corpus: np.ndarray, test: np.ndarray) -> np.ndarray:
        """Lengths of the common runs of pairs that share ``width`` words, by names of runs of doubling width, so a run of n words takes log n steps."""
        joined = np.concatenate([codes, [0], self.codes])
        first, second = corpus, test + len(codes) + 1
        names, width, steps = joined, 1, []
        while True:
            steps.append((names, width))
            if len(names) <= width:
                break
            left, right = names[:-width], names[width:]
            longer = np.zeros(len(left), np.int64)
            sound = np.flatnonzero((left != 0) & (right != 0))
            _, name = np.unique(left[sound] * (int(names.max()) + 1) + right[sound], return_inverse=True)
            longer[sound] = name + 1
            names, width = longer, 2 * width
            inside = second < len(names)
            if not ((names[first[inside & (first < len(names))]] == names[second[inside & (first < len(names))]]) & (names[first[inside & (first < len(names))]] != 0)).any():
                break
        length = np.zeros(len(first), np.int64)
        for names, width in reversed(steps):
            a, b = first + length, second + length
            inside = (a < len(names)) & (b < len(names))
            same = np.zeros(len(a), bool)
            same[inside] = (names[a[inside]] == names[b[inside]]) & (names[a[inside]] != 0)
            length[same] += width
        return length


def _pair(keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each key with the word before it as one byte string, in the order of both."""
    width = keys.dtype.itemsize
    out = np.empty((len(keys), width + 4), np.uint8)
    out[:, :width] = keys.view(np.uint8).reshape(len(keys), width)
    out[:, width:] = before.astype(">u4").view(np.uint8).reshape(len(keys), 4)
    return out.view(f"S{width + 4}").ravel()


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [low, high), and the number of the range of each."""
    counts = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[owner], owner


def _searcher(slices: list):
    """Search every slice of the test items in one pass over the documents; one slice is held at a time."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(suffixes: TestSuffixes, ids: list, texts: list[list[str]]) -> pd.DataFrame:
            get = suffixes.vocabulary.get
            lengths = np.fromiter((len(words) + 1 for words in texts), np.int64, len(texts))
            codes = np.fromiter((code for words in texts for code in (*map(get, words, repeat(0)), 0)), np.int64, lengths.sum())
            owner, first = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
            corpus, test, length = suffixes.search(codes)
            rows = pd.DataFrame({"doc": owner[corpus], "item": suffixes.owners[test], "n_words": length, "at": corpus - first[owner[corpus]]})
            best = rows.sort_values(["doc", "item", "n_words", "at"], ascending=[True, True, False, True]).drop_duplicates(["doc", "item"])
            return pd.DataFrame({"doc_id": [ids[i] for i in best.doc], "item_id": [suffixes.ids[i] for i in best["item"]], "n_words": best.n_words.to_numpy(), "word_pos": best["at"].to_numpy()})

        def in_every_slice(ids: list, texts: list[list[str]]) -> Iterator[pd.DataFrame]:
            for part in slices:
                yield found(part.value, ids, texts)
                if len(slices) > 1:
                    part.__dict__.pop("_value", None)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(words_of(text))
                size += len(texts[-1])
                if size >= SHARD_WORDS:
                    yield from in_every_slice(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield from in_every_slice(ids, texts)

    return search


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Documents that share a run of at least ``min_words`` words with a test item: doc_id, item_id, n_words, word_pos.

    n_words is the longest shared run, word_pos the number of the document's word where it starts (from 0). Null or empty
    texts match nothing; repeated rows of a document or item count once; a null doc_id is reported as null. The test items
    go to the executors in slices of bounded size, of which driver and tasks hold one at a time; the corpus is read and its
    words are found once, without a shuffle, however many slices there are. Work grows with the lengths of the texts, also
    where one word or phrase fills a text: only runs that can't be longer to the left are looked at.
    """
    tests = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = []
    count = size // item_bytes + 1
    for number in range(count):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == number).orderBy("item_id").collect()
        slices.append(documents.sparkSession.sparkContext.broadcast(TestSuffixes([r.item_id for r in rows], [r.text for r in rows], min_words)))
    parts = documents.select("doc_id", "text").where("text is not null").mapInPandas(_searcher(slices), "doc_id long, item_id long, n_words long, word_pos long")
    best = parts.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("word_pos")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_words").alias("n_words"), (-F.col("best.back")).alias("word_pos"))


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that contain no passage of the test items; rows with a null doc_id stay."""
    return documents.join(leaked_passages(documents, items, min_words).select("doc_id").distinct(), "doc_id", "left_anti")
