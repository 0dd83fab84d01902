"""Sources mixed to target shares by weighted fair queueing over token counts."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.running import beside, ranged_running_sum
from chatlake.session import settle

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
BUDGET_SHARE = 0.5
"""Share of the tokens of the target sources' documents that a mix without a stated budget may spend."""


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counting", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of the whole texts by a public tokenizer (file name or path); null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "source": batch.source, "n_tokens": [len(encode(text)) if text else 0 for text in batch.text]})

    columns = documents.select("doc_id", "source", "text")
    return columns.mapInPandas(count, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, source string, n_tokens long")


def canonical(source: Column) -> Column:
    """One spelling of a source: lower case, with one underscore for spaces and separators, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def _wanted(targets: DataFrame) -> DataFrame:
    return targets.where("source is not null and target_share > 0").select(canonical(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))


def mixed(documents: DataFrame, targets: DataFrame, budget: int | None = None, budget_share: float = BUDGET_SHARE, tokenizer: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """The copies chosen for the mix: doc_id, source, repeat_no, n_tokens, finish.

    Each source's documents are shuffled by a seeded hash, once per allowed repeat, all first uses before the second ones. A
    copy's virtual finish time is its source's tokens so far divided by the target share. All copies are sorted by these times
    (ties by source, document and repeat) in sampled ranges and taken until the budget of tokens is spent; the first copy
    that doesn't fit ends the mix. ``budget`` is a number of tokens; without it the budget is ``budget_share`` of the tokens
    that the documents of the target sources have, each counted once. A source that runs out leaves its share to the others
    in proportion; ``share_report`` says which ones and why. Documents without tokens, without a source or with one that has
    no target above 0 aren't used; a null max_repeats counts as 1. Equal documents with different ids are different documents.
    """
    wanted = _wanted(targets)
    known = documents.select("doc_id", canonical(F.col("source")).alias("source"), "text")
    sized = settle(with_tokens(known.join(wanted, "source", "left_semi"), tokenizer).where("n_tokens > 0").join(wanted, "source"))
    limit = F.lit(budget).cast("long")
    if budget is None:
        limit = F.floor(F.lit(budget_share) * F.coalesce(F.sum("n_tokens"), F.lit(0))).cast("long")
    limits = sized.agg(limit.alias("budget"))
    copies = sized.where("max_repeats > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    queued = copies.withColumn("place", F.xxhash64("doc_id", "repeat_no", F.lit(seed)))
    timed = ranged_running_sum(queued, ["source"], ["repeat_no", "place", "doc_id"], {"before": "n_tokens"})
    finished = timed.select("doc_id", "source", "repeat_no", "n_tokens", ((F.col("before") + F.col("n_tokens")) / F.col("target_share")).alias("finish"))
    spent = ranged_running_sum(finished, [], ["finish", "source", "doc_id", "repeat_no"], {"spent": "n_tokens"})
    return beside(spent, limits).where(F.col("spent") + F.col("n_tokens") <= F.col("budget")).select("doc_id", "source", "repeat_no", "n_tokens", "finish")


def share_report(mix: DataFrame, targets: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per target source: source, target_share, actual_share, n_tokens, n_copies, n_documents, most_repeats, missed; all targets appear.

    ``missed`` needs the ``documents``: null for a source that had copies left, ``no documents`` for one without any, ``used up``
    for one all of whose documents were used max_repeats times, which leaves its share to the others.
    """
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_copies"), F.sum(F.when(F.col("repeat_no") == 1, 1).otherwise(0)).alias("n_documents"), F.max("repeat_no").alias("most_repeats"))
    total = used.agg(F.sum("n_tokens").alias("total"))
    rows = targets.where("source is not null").select(canonical(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).join(used, "source", "left").join(total, F.lit(True), "left")
    zero = F.lit(0)
    missed = F.lit(None).cast("string")
    if documents is not None:
        stock = documents.where(F.length("text") > 0).groupBy(canonical(F.col("source")).alias("source")).agg(F.count("*").alias("stock"))
        rows = rows.join(stock, "source", "left")
        missed = F.when(F.coalesce("stock", zero) * F.col("max_repeats") == 0, "no documents").when(F.col("n_copies") >= F.col("stock") * F.col("max_repeats"), "used up")
    return rows.select("source", "target_share", F.coalesce(F.col("n_tokens") / F.col("total"), zero.cast("double")).alias("actual_share"), *[F.coalesce(c, zero).cast("long").alias(c) for c in ("n_tokens", "n_copies", "n_documents", "most_repeats")], missed.alias("missed"))
