"""Near-equal texts by longest common subsequence."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 1000
"""A sample up to this size is sent to every task and compared there; more texts are compared in blocks."""

BAND = math.log(1.2)
"""Texts of one band differ in length by less than 20 %; narrower bands mean more and smaller comparisons."""
BANDS = 128
"""More bands than the lengths of strings can make."""
BLOCK = 32_768
"""About as many texts a block of a band has at most; two blocks at a time are compared in memory."""
SIZE = 4_000_000
"""About as many characters a block has at most."""
BUCKETS = 512
"""Characters are counted modulo this; characters that share a bucket only raise the bound."""
RUN, GROUP, PAIRS = 8192, 64, 16_384
"""As many texts of a block are compared at once with one text of the other, as many texts in order take the same selection of them, and as many single pairs are compared at once."""
MASKS = 16_000_000
"""Words of bit masks in memory at a time."""
CALL = 800
"""A call of NumPy takes as long as so many words."""
DEPTH, CELL = 0.55, 16
"""After this share of the symbols of one text pairs are left out that cannot reach the threshold; the place where the other text splits is known within so many."""
WIDE = 64
"""Texts of more words than this are compared one pair at a time."""


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence in code points, by bit vectors: a word operation covers 64 cells."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_string(a: str, b: str) -> str:
    """One longest common subsequence; going back through the table it moves up only if that is strictly better, else left."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        last, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        table.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def lcs_similarity(a: str | None, b: str | None) -> float:
    """Longest common subsequence over the longer length; 0 if either is empty or null."""
    return lcs_length(a, b) / max(len(a), len(b)) if a and b else 0.0


def lcs_ratio(a: Column | str, b: Column | str) -> Column:
    """lcs_similarity of two text columns, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def _possible(a: str, b: str, counts_a: Counter, counts_b: Counter, threshold: float) -> bool:
    """Bounds no pair at the threshold fails: the lengths' ratio and the characters the texts share."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < threshold * longer:
        return False
    return sum((counts_a & counts_b).values()) >= threshold * longer - 1e-9


def similar_to(messages: DataFrame, message_id: int, threshold: float = 0.7, limit: int = 10, min_length: int = 20) -> DataFrame:
    """The messages most like one: id, similarity; longer than ``min_length``, the message itself left out."""
    own = messages.where(F.col("id") == message_id).select("text_plain").first()
    text = (own["text_plain"] if own else None) or ""
    rows = messages.where((F.length("text_plain") > min_length) & (F.col("id") != message_id) & F.length("text_plain").between(int(len(text) * threshold), int(len(text) / threshold) + 1))
    scored = rows.select("id", lcs_ratio("text_plain", F.lit(text)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def similar_pairs(sample: DataFrame, threshold: float = 0.7, min_length: int = 20, other_user: bool = False) -> DataFrame:
    """Pairs id_1 < id_2 of a sample (id, from_id, text_plain) with their similarity; ``other_user`` leaves out pairs of one sender.

    Up to SAMPLE rows are sent to every task and each is compared with the later ones, so nothing is shuffled; a larger sample
    is compared in blocks, as ``similar_texts`` does, with the same result.
    """
    rows = sample.where(F.length("text_plain") >= min_length).select("id", "from_id", "text_plain").orderBy("id").limit(SAMPLE + 1).collect()
    if len(rows) > SAMPLE:
        found = expanded(similar_texts(sample, threshold, min_length), text_classes(sample, min_length))
        senders = sample.select("id", "from_id")
        one, two = senders.toDF("id_1", "from_1"), senders.toDF("id_2", "from_2")
        return found if not other_user else found.join(one, "id_1").join(two, "id_2").where("not (from_1 <=> from_2)").select("id_1", "id_2", "similarity")
    texts = [(r.id, r.from_id, r.text_plain, Counter(r.text_plain)) for r in rows]
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(texts)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in batch.id:
                one, sender, text, counts = shared.value[at]
                for other, their_sender, their_text, their_counts in shared.value[at + 1 :]:
                    if other_user and sender == their_sender or not _possible(text, their_text, counts, their_counts, threshold):
                        continue
                    similarity = lcs_similarity(text, their_text)
                    if similarity >= threshold:
                        out.append((one, other, similarity))
            yield pd.DataFrame(out, columns=["id_1", "id_2", "similarity"])

    return spark.range(len(texts), numPartitions=min(64, max(1, len(texts)))).mapInPandas(compare, "id_1 long, id_2 long, similarity double")


def _codes(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


class _Texts:
    """A block of different texts in their order, as symbols from 1 of an alphabet that two blocks share."""

    def __init__(self, rows: pd.DataFrame, symbols: np.ndarray, size: int) -> None:
        rows = rows.sort_values("text", kind="stable")
        self.reps, self.texts, self.size, n = rows.rep.to_numpy(), rows.text.tolist(), size, len(rows)
        self.lengths = np.array([len(t) for t in self.texts])
        flat, who = symbols[np.concatenate(_codes(self.texts))], np.repeat(np.arange(n), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.columns = np.zeros((int(self.lengths.max()), n), np.min_scalar_type(size))
        self.columns[np.arange(len(flat)) - starts[who], who] = flat
        self.symbols = np.split(flat, starts[1:])
        self.buckets = min(BUCKETS, size + 1)
        counts = np.bincount(flat % self.buckets * n + who, minlength=self.buckets * n).reshape(self.buckets, n)
        self.counts = counts.astype(np.min_scalar_type(int(self.lengths.max())))
        same = np.logical_and.accumulate(self.columns[:, 1:] == self.columns[:, :-1], axis=0).sum(0)
        #: Symbols each text begins with like the text before it.
        self.shared = np.concatenate([[0], same])


class _Chunk:
    """Some texts of a block as bit masks by symbol: all are compared with one other text at a time, a word of 63 bits after the other."""

    def __init__(self, block: _Texts, at: np.ndarray) -> None:
        self.at, self.lengths, self.reps = at, block.lengths[at], block.reps[at]
        self.counts, self.capped = np.ascontiguousarray(block.counts[:, at]), {}
        self.most = self.counts.max(1).astype(np.int64)
        self.words = -(-int(self.lengths.max()) // 63)
        self.masks = np.zeros((self.words, block.size + 1, len(at)), np.uint64)
        here = np.arange(len(at))
        for i, column in enumerate(block.columns[: int(self.lengths.max()), at]):
            self.masks[i // 63, column, here] |= np.uint64(1 << i % 63)
        self.masks[:, 0] = 0
        self.endings: dict[int, np.ndarray] = {}
        self.block = block

    def ending(self, start: int) -> np.ndarray:
        """Counts by bucket of what each text has from a place on."""
        if start not in self.endings:
            n, found = len(self.at), self.counts.astype(np.int64)
            here = np.arange(n)
            for column in self.block.columns[:start, self.at]:
                found[column.astype(np.int64) % self.block.buckets, here] -= column > 0
            self.endings[start] = found.astype(self.counts.dtype)
        return self.endings[start]

    def overlap(self, buckets: list[int], times: list[int]) -> np.ndarray:
        """How many characters each text shares at most with one that has these buckets so often."""
        found = np.zeros(len(self.at), np.uint64 if self.counts.dtype.itemsize > 2 else self.counts.dtype)
        for key in zip(buckets, times, strict=True):
            if (row := self.capped.get(key)) is None:
                row = self.capped[key] = np.minimum(self.counts[key[0]], np.full(len(self.at), min(key[1], np.iinfo(self.counts.dtype).max), self.counts.dtype))
            np.add(found, row, out=found)
        return found


def _step(rows: list[np.ndarray], masks: list[np.ndarray], first: int, last: int, hit: np.ndarray, total: np.ndarray) -> None:
    """One more character of the other text, in place; the top bit of a word hands the carry on. Words before ``first`` and after ``last`` have no match."""
    for w in range(first, min(last, len(rows) - 1) + 1):
        row = rows[w]
        np.bitwise_and(row, masks[w], out=hit)
        np.add(row, hit, out=total)
        if w > first:
            np.add(total, carry, out=total)  # noqa: F821
        if w < len(rows) - 1:
            carry = total >> _TOP  # noqa: F841
        np.bitwise_xor(row, hit, out=row)
        np.bitwise_or(row, total, out=row)
        np.bitwise_and(row, _LOW, out=row)


def _spare(n: np.ndarray, threshold: float) -> int:
    """So many symbols of a text at most stay unmatched at the threshold, thus so far apart at most are the places of a match."""
    return int((1 - threshold) * int(n.max()) + 1e-6)


_TOP, _LOW = np.uint64(63), np.uint64((1 << 63) - 1)


def _found(rows: list[np.ndarray], end: int | None = None) -> np.ndarray:
    """The lcs lengths that the words stand for, up to a place of the texts they belong to."""
    end = min(63 * len(rows), end or 63 * len(rows))
    return end - sum(np.bitwise_count(r if 63 * w + 63 <= end else r & np.uint64((1 << end - 63 * w) - 1)).astype(np.int32) for w, r in enumerate(rows) if 63 * w < end)


def _in_order(chunk: _Chunk, block: _Texts, low: int, high: int, near: np.ndarray, depth: int, needs: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each text of a stretch of a block, which of the texts ``near`` can still reach what they need after its first ``depth`` symbols, and the words of all.

    The symbols the text shares with the one before it are not computed again. A text splits where the first symbols' matches end, within a place of CELL that the
    unmatched symbols allow; before that end the lcs so far counts, behind its start no more than the common characters of both rests.
    """
    masks = {int(c): [m[c].take(near) for m in chunk.masks] for c in np.unique(block.columns[:depth, low:high]) if c}
    hit, total = np.empty(len(near), np.uint64), np.empty(len(near), np.uint64)
    saved = [(0, [np.full(len(near), _LOW) for _ in range(chunk.words)])]
    up, down = _spare(chunk.lengths[near], threshold), _spare(block.lengths[low:high], threshold)
    rests = np.array([np.bincount(s[depth:] % block.buckets, minlength=block.buckets) for s in block.symbols[low:high]])
    has, limit = np.flatnonzero(rests.max(0)), np.iinfo(chunk.counts.dtype).max
    once = [(i, k) for i, most in enumerate(rests[:, has].max(0).tolist()) for k in range(1, min(most, limit) + 1)]
    kind, times = (np.array(x) for x in zip(*once, strict=True))
    ours, times = (rests[:, has[kind]] >= times).astype(np.float32), times.astype(chunk.counts.dtype)[:, None]
    starts = range(max(0, depth - down) // CELL * CELL, min(int(chunk.lengths[near].max()), depth + up) + 1, CELL)
    theirs = (np.stack([chunk.ending(start)[c].take(near) for c in has])[kind] >= times for start in starts)
    behind = [ours @ x.astype(np.float32) for x in theirs]
    begun, before = None, []
    for j in range(low, high):
        at = min(int(block.shared[j]), depth) if j > low else 0
        if at < depth or begun is None:
            while saved[-1][0] > at:
                saved.pop()
            later, first = [], depth
            for s in block.shared[j + 1 : high].tolist():
                if s <= at:
                    break
                if s < first:
                    later.append(first := s)
            begun = [r.copy() for r in saved[-1][1]]
            for k in range(at, depth):
                _step(begun, masks[int(block.columns[k, j])], max(0, k - down) // 63, (k + up) // 63, hit, total)
                if later and later[-1] == k + 1:
                    saved.append((later.pop(), [r.copy() for r in begun]))
            before = [_found(begun, start + CELL).astype(np.float32) for start in starts]
        best = before[0] + behind[0][j - low]
        for x, y in zip(before[1:], behind[1:], strict=True):
            np.maximum(best, x + y[j - low], out=best)
        yield j, best >= needs, begun


def _side_by_side(chunk: _Chunk, block: _Texts, near: np.ndarray, others: np.ndarray, depth: int, rows: list[np.ndarray], threshold: float) -> np.ndarray:
    """lcs lengths, if they reach the threshold, of single pairs, texts ``near`` of a chunk and ``others`` of a block, from their words after ``depth`` symbols."""
    hit, total, flat = np.empty(len(near), np.uint64), np.empty(len(near), np.uint64), [m.reshape(-1) for m in chunk.masks]
    up, down = _spare(chunk.lengths[near], threshold), _spare(block.lengths[others], threshold)
    for k in range(depth, int(block.lengths[others].max())):
        at, first, last = block.columns[k].take(others) * np.int64(len(chunk.at)) + near, max(0, k - down) // 63, (k + up) // 63
        _step(rows, [m.take(at) if first <= w <= last else m for w, m in enumerate(flat)], first, last, hit, total)
    return _found(rows)


def _compared(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Pairs of two blocks (rep, text), or of one with itself, at the threshold."""
    own = right is None
    codes = np.concatenate(_codes([*left.text, *([] if own else right.text)]))
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    symbols = np.cumsum(seen, dtype=np.int32).astype(np.int64)
    one = _Texts(left, symbols, int(symbols[-1]))
    two = one if own else _Texts(right, symbols, int(symbols[-1]))
    least = lambda n: np.ceil(threshold * n - 1e-9).astype(np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, lcs: np.ndarray) -> None:
        similarity = lcs / np.maximum(n, m)
        kept = similarity >= threshold
        out.append((a[kept], b[kept], similarity[kept]))

    totals = [np.unique(s % two.buckets, return_counts=True) for s in two.symbols]
    totals = [(b.tolist(), n.tolist()) for b, n in totals]
    order, at = np.argsort(one.lengths, kind="stable"), 0
    depth = max(1, min(int(DEPTH * np.median(two.lengths)), int(two.lengths.min()) - 1))
    while at < len(order):
        words = -(-int(one.lengths[order[min(at + RUN, len(order)) - 1]]) // 63)
        chunk = _Chunk(one, order[at : at + max(1, min(RUN, MASKS // (words * (one.size + 1))))])
        at += len(chunk.at)
        needs = least(chunk.lengths)
        waiting: dict[int, list[tuple]] = {0: [], depth: []}
        count = dict.fromkeys(waiting, 0)

        def put(start: int, near: np.ndarray, others: np.ndarray, rows: list[np.ndarray]) -> None:
            waiting[start].append((near, others, *rows))
            count[start] += len(near)
            if count[start] >= PAIRS:
                flush(start)

        def flush(start: int) -> None:
            near, others, *rows = (np.concatenate(x) for x in zip(*waiting[start], strict=True))
            for k in range(0, len(near), PAIRS):
                a, b = near[k : k + PAIRS], others[k : k + PAIRS]
                if chunk.words > WIDE:
                    lcs = np.array([lcs_length(one.texts[chunk.at[x]], two.texts[y]) for x, y in zip(a, b, strict=True)])
                else:
                    lcs = _side_by_side(chunk, two, a, b, start, [r[k : k + PAIRS].copy() for r in rows] or [np.full(len(a), _LOW) for _ in range(chunk.words)], threshold)
                keep(chunk.reps[a], two.reps[b], chunk.lengths[a], two.lengths[b], lcs)
            waiting[start].clear()
            count[start] = 0

        for low in range(0, len(two.reps), GROUP):
            high = min(low + GROUP, len(two.reps))
            most = two.counts[:, low:high].max(1).astype(np.int64)
            has, shortest = np.flatnonzero(most), least(two.lengths[low:high].min())
            if np.minimum(chunk.most[has], most[has]).sum() < max(shortest, needs[0]):
                continue
            enough = np.empty((high - low, len(chunk.at)), bool)
            for j in range(low, high):
                np.greater_equal(chunk.overlap(*totals[j]), np.maximum(needs, least(two.lengths[j])).astype(chunk.counts.dtype), out=enough[j - low])
                if own:
                    enough[j - low] &= chunk.at > j
            near, number = np.flatnonzero(enough.any(0)), int(enough.sum())
            if not number:
                continue
            cells, steps = int(0.7 * chunk.lengths[-1]) // CELL + 1, int((depth - np.minimum(two.shared[low + 1 : high], depth)).sum()) + depth
            ordered = 4 * (len(near) + CALL) * (chunk.words * steps + 3 * cells * (high - low))
            if chunk.words > WIDE or number * chunk.words * int(two.lengths[low:high].max()) * 9 < ordered:
                b, a = np.nonzero(enough)
                put(0, a, b + low, [])
                continue
            enough = enough[:, near]
            for j, able, rows in _in_order(chunk, two, low, high, near, depth, np.maximum(needs[near], shortest), threshold):
                left = np.flatnonzero(able & enough[j - low])
                if len(left):
                    put(depth, near[left], np.full(len(left), j), [r.take(left) for r in rows])
        for start in waiting:
            if waiting[start]:
                flush(start)
    rep_1, rep_2, similarity = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    return pd.DataFrame({"rep_1": rep_1, "rep_2": rep_2, "similarity": similarity})


def text_classes(messages: DataFrame, min_length: int = 20) -> DataFrame:
    """id, class_id: messages with one and the same text of at least ``min_length`` form a class, named by its smallest id. Null ids and texts have none."""
    rows = messages.where((F.length("text_plain") >= max(1, min_length)) & F.col("id").isNotNull()).select("id", F.col("text_plain").alias("text"))
    return rows.join(rows.groupBy("text").agg(F.min("id").alias("class_id")), "text").select("id", "class_id").distinct()


def expanded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """id_1 < id_2, similarity of single messages from pairs of classes and their members: for samples only, copies multiply."""
    one, two = classes.select(F.col("class_id").alias("class_1"), F.col("id").alias("a")), classes.select(F.col("class_id").alias("class_2"), F.col("id").alias("b"))
    across = pairs.join(one, "class_1").join(two, "class_2").select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), "similarity")
    equal = one.join(two, F.col("class_1") == F.col("class_2")).where("a < b").select(F.col("a").alias("id_1"), F.col("b").alias("id_2"), F.lit(1.0).alias("similarity"))
    return across.unionByName(equal)


def similar_texts(messages: DataFrame, threshold: float = 0.7, min_length: int = 20) -> DataFrame:
    """class_1 < class_2, similarity: every pair of different texts of at least ``min_length`` at the threshold; no sample, no limit.

    Equal texts are one class (``text_classes``), so copies cost nothing. The others are cut into blocks of like length in the order of the texts, and each text meets the
    blocks whose lengths allow the threshold (``_compared``): common characters come first, then a bound after a part of the text, then the lcs.
    Work and result still grow with the square of the distinct texts.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    from chatlake.session import settle

    rows = messages.where((F.length("text_plain") >= max(1, min_length)) & F.col("id").isNotNull()).select("id", F.col("text_plain").alias("text"))
    about = rows.agg(F.approx_count_distinct("text").alias("n"), F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("length")).first()
    parts = max(1, math.ceil(about.n / BLOCK), math.ceil(about.n * about.length / SIZE))
    members = rows.groupBy("text").agg(F.min("id").alias("rep")).select("rep", "text", F.length("text").alias("n"), F.floor(F.log(F.length("text").cast("double")) / BAND).cast("long").alias("band"))
    ordered = members.repartitionByRange(parts, "band", "text").sortWithinPartitions("band", "text")
    placed = settle(ordered.select("rep", "text", "n", (F.spark_partition_id() * F.lit(BANDS) + F.col("band")).cast("long").alias("block")))
    blocks = placed.groupBy(F.col("block").alias("their")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sent = placed.join(F.broadcast(blocks), (F.col("high") >= threshold * F.col("n") - 1e-9) & (F.col("n") >= threshold * F.col("low") - 1e-9))
    keyed = sent.select("rep", "text", F.least("block", "their").alias("lower"), F.greatest("block", "their").alias("upper"), (F.col("block") > F.col("their")).alias("above"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[~rows.above], rows[rows.above]
        if rows.lower.iloc[0] == rows.upper.iloc[0]:
            return _compared(left, None, threshold)
        return _compared(left, right, threshold) if len(left) and len(right) else pd.DataFrame({"rep_1": [], "rep_2": [], "similarity": []})

    tasks = max(4 * int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, parts * parts))
    found = keyed.repartition(tasks, "lower", "upper").groupBy("lower", "upper").applyInPandas(compare, "rep_1 long, rep_2 long, similarity double")
    return found.select(F.least("rep_1", "rep_2").alias("class_1"), F.greatest("rep_1", "rep_2").alias("class_2"), "similarity")


def reposts(messages: DataFrame, threshold: float = 0.9, newest: int = 500, min_length: int = 50) -> DataFrame:
    """Pairs of like texts of different senders among the newest longer messages."""
    recent = messages.where(F.length("text_plain") >= min_length).orderBy(F.desc("date_unixtime"), "id").limit(newest)
    return similar_pairs(recent, threshold, min_length, other_user=True)


def with_previews(pairs: DataFrame, messages: DataFrame, length: int = 100) -> DataFrame:
    """Each pair with the start of either text, each joined by its own id."""
    one = messages.select(F.col("id").alias("id_1"), F.substring("text_plain", 1, length).alias("text_1"))
    two = messages.select(F.col("id").alias("id_2"), F.substring("text_plain", 1, length).alias("text_2"))
    return pairs.join(one, "id_1").join(two, "id_2")
