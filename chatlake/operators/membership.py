"""A Bloom filter to hand to others; inside the engine membership is exact (joins)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8192


class BloomFilter:
    """Bits for ``expected`` items at a false-positive rate; no false negatives. Adding is by double hashing of two digests."""

    def __init__(self, expected: int = 100_000, rate: float = 0.01) -> None:
        self.size = int(-expected * math.log(rate) / math.log(2) ** 2)
        self.hashes = max(1, int(self.size / expected * math.log(2)))
        self.bits = np.zeros(-(-self.size // 8), np.uint8)
        self.count = 0

    def positions(self, item: object) -> list[int]:
        raw = str(item).encode("utf-8", "replace")
        a, b = int(hashlib.md5(raw).hexdigest(), 16), int(hashlib.sha1(raw).hexdigest(), 16)
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def add(self, item: object) -> None:
        for p in self.positions(item):
            self.bits[p >> 3] |= 1 << (p & 7)
        self.count += 1

    def __contains__(self, item: object) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.positions(item))

    def __len__(self) -> int:
        return self.count

    def memory_usage(self) -> int:
        return self.bits.nbytes


def bloom_of(rows: DataFrame, column: str, expected: int, rate: float = 0.01) -> BloomFilter:
    """The filter of a column, built where the rows are: tasks send the pieces of their bit arrays, which are joined piece by piece. The result has a fixed size."""
    whole = BloomFilter(expected, rate)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = BloomFilter(expected, rate), 0
        for batch in batches:
            for item in batch["item"]:
                own.add(item)
                n += 1
        pieces = range(0, len(own.bits), PIECE)
        kept = [(at // PIECE, own.bits[at : at + PIECE].tobytes(), n if at == 0 else 0) for at in pieces if at == 0 or own.bits[at : at + PIECE].any()]
        yield pd.DataFrame(kept, columns=["piece", "bits", "n"])

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in part.bits])
        return pd.DataFrame({"piece": [part.piece.iloc[0]], "bits": [bits.tobytes()], "n": [int(part.n.sum())]})

    source = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("item")).distinct()
    parts = source.mapInPandas(partial, "piece int, bits binary, n long").groupBy("piece").applyInPandas(joined, "piece int, bits binary, n long")
    for row in parts.collect():
        at = row.piece * PIECE
        whole.bits[at : at + len(row.bits)] |= np.frombuffer(row.bits, np.uint8)
        whole.count += row.n
    return whole
