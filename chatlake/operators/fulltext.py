"""Full-text search over postings: boolean and positional matching, two BM25 rankings, prefix lookup, autocomplete, fuzzy search."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import trigrams, unicode_words
from chatlake.plans import fts_query as Q
from chatlake.operators.running import beside

WEIGHTS = {"text_plain": 1.0, "from_name": 0.5}
# Constants of the two rankings.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
OKAPI_K1, OKAPI_B, OKAPI_EPSILON = 1.5, 0.75, 0.25

BUCKETS = 32
"""Folders a stored index is cut into by the first character of its terms."""

_RUN = re.compile(r"[^\W_]+")
_HEBREW_MARKS = re.compile("[֑-ׇֽֿׁׂׅׄ]")


def tokenize(text: str | None, strict: bool = False) -> list[str]:
    """Lower-case runs of letters and digits without diacritics. ``strict`` lets Hebrew vowel points part words instead of vanishing."""
    if not text:
        return []
    if strict:
        text = _HEBREW_MARKS.sub(" ", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return _RUN.findall(text.lower())


def bucket_of(term: str) -> int:
    """Where the postings of a term, or of all terms with a prefix, are stored: by the first character."""
    return ord(term[0]) % BUCKETS


def bucketed(rows: DataFrame, term: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.ascii(term), F.lit(BUCKETS)))


@dataclass
class Index:
    """table: bucket, term, id, col, n_tokens of the document over all columns, positions; documents: id, n_tokens; totals: one row n_docs, mean_tokens.

    Built in the query by ``build_index``, or read from where it was stored, so that a look-up reads the buckets of its terms only.
    """

    table: DataFrame
    documents: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """id, col, term, pos, n_tokens of every occurrence."""
        return self.table.select("id", "col", "term", F.explode("positions").alias("pos"), "n_tokens")

    def of(self, terms: list[str]) -> DataFrame:
        """The stored rows of the buckets of some terms or prefixes."""
        return self.table.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms if t})))


def posting_table(messages: DataFrame, columns: tuple[str, ...] = ("text_plain", "from_name"), strict: bool = False) -> DataFrame:
    """bucket, term, id, col, n_tokens, positions: one row per word of a column of a document. Null texts have none."""
    places = "array<struct<term:string,positions:array<int>>>"

    @F.pandas_udf(f"struct<n:int,{','.join(f'{c}:{places}' for c in columns)}>")
    def tokens(*texts: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"n": [0] * len(texts[0])} | {c: [] for c in columns}
        for column, series in zip(columns, texts, strict=True):
            for row, text in enumerate(series):
                found: dict[str, list[int]] = {}
                words = tokenize(text, strict)
                for at, word in enumerate(words):
                    found.setdefault(word, []).append(at)
                out["n"][row] += len(words)
                out[column].append([{"term": word, "positions": where} for word, where in found.items()])
        return pd.DataFrame(out)

    parted = messages.select("id", tokens(*[F.col(c) for c in columns]).alias("t"))

    def of_column(name: str) -> Column:
        return F.transform(f"t.{name}", lambda p: F.struct(F.lit(name).alias("col"), p["term"].alias("term"), p["positions"].alias("positions")))

    parts = F.flatten(F.array(*map(of_column, columns)))
    rows = parted.select("id", F.col("t.n").cast("long").alias("n_tokens"), F.explode(parts).alias("p"))
    return bucketed(rows.select("p.term", "id", "p.col", "n_tokens", "p.positions"), "term")


def document_table(messages: DataFrame, columns: tuple[str, ...] = ("text_plain", "from_name"), strict: bool = False) -> DataFrame:
    """id, n_tokens of every row: a document without a word has 0."""

    @F.pandas_udf("long")
    def count(*texts: pd.Series) -> pd.Series:
        return sum(series.map(lambda t: len(tokenize(t, strict))) for series in texts)

    return messages.select("id", count(*[F.col(c) for c in columns]).alias("n_tokens"))


def totals_of(documents: DataFrame) -> DataFrame:
    """n_docs, sum_tokens: the numbers of a set of documents, which add up over sets."""
    return documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("sum_tokens"))


def mean_totals(parts: DataFrame) -> DataFrame:
    """n_docs, mean_tokens from the totals of sets of documents."""
    return parts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("sum_tokens") / F.sum("n_docs")).alias("mean_tokens"))


def build_index(messages: DataFrame, columns: tuple[str, ...] = ("text_plain", "from_name"), strict: bool = False) -> Index:
    """An index of the text columns that lives in the query; ``sinks.store`` keeps the same tables for many queries."""
    documents = document_table(messages, columns, strict)
    return Index(posting_table(messages, columns, strict), documents, mean_totals(totals_of(documents)))


def _starts(index: Index, phrase: Q.Phrase) -> DataFrame:
    """id, col, start, n_tokens of each occurrence of a phrase, by one aggregation over the postings of its words."""
    tests = []
    for i, token in enumerate(phrase.tokens):
        same = F.col("term").startswith(token) if phrase.prefix and i == len(phrase.tokens) - 1 else F.col("term") == token
        tests.append((i, same))
    rows = index.of(phrase.tokens).where(reduce(lambda a, b: a | b, [test for _, test in tests]))
    if phrase.columns is not None:
        rows = rows.where(F.col("col").isin(*phrase.columns))
    rows = rows.select("id", "col", "term", F.explode("positions").alias("pos"), "n_tokens")
    if len(tests) == 1:
        found = rows.select("id", "col", F.col("pos").alias("start"), "n_tokens")
    else:
        places = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in tests]))
        spread = rows.select("id", "col", "pos", "n_tokens", F.explode(places).alias("place")).withColumn("start", F.col("pos") - F.col("place"))
        found = spread.groupBy("id", "col", "start", "n_tokens").agg(F.countDistinct("place").alias("n")).where(F.col("n") == len(tests)).drop("n")
    return found.where("start = 0") if phrase.first else found


def _near(index: Index, near: Q.Near) -> DataFrame:
    """Occurrences of all phrases of a NEAR group within its distance; the count of an id is that of its anchors."""
    parts = []
    for number, phrase in enumerate(near.phrases):
        phrase.columns = near.columns
        parts.append(_starts(index, phrase).withColumn("number", F.lit(number)).withColumn("size", F.lit(len(phrase.tokens))))
    rows = reduce(DataFrame.unionByName, parts)
    hits = []
    for size in sorted({len(p.tokens) for p in near.phrases}):
        frame = Window.partitionBy("id", "col").orderBy("start").rangeBetween(0, near.distance + size)
        seen = rows.withColumn("seen", F.size(F.collect_set("number").over(frame)))
        hits.append(seen.where((F.col("size") == size) & (F.col("seen") == len(near.phrases))).select("id", "col", "start", "n_tokens"))
    return reduce(DataFrame.unionByName, hits)


def match(index: Index, query: str, columns: tuple[str, ...] = ("text_plain", "from_name"), weights: dict[str, float] = WEIGHTS, strict: bool = False) -> DataFrame:
    """id, score of the documents that match a query; the best score is the lowest. Malformed queries raise QueryError.

    Every word or phrase gives weighted counts per document; one aggregation turns them into flags for the boolean tree and
    into the BM25 sum. A phrase without any token matches nothing.
    """
    tree = Q.parse(query, columns, lambda t: tokenize(t, strict))
    parts = Q.leaves(tree)
    weight = reduce(lambda e, kv: e.when(F.col("col") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    counted = []
    for number, leaf in enumerate(parts):
        if isinstance(leaf, Q.Phrase) and not leaf.tokens:
            continue
        found = _near(index, leaf) if isinstance(leaf, Q.Near) else _starts(index, leaf)
        counted.append(found.groupBy("id", "n_tokens").agg(F.sum(weight).alias("f")).withColumn("leaf", F.lit(number)))
    if not counted:
        return index.documents.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    hits = reduce(DataFrame.unionByName, counted)
    share = hits.groupBy("leaf").agg(F.count("*").alias("n"))
    idf = F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = share.transform(beside, index.totals).select("leaf", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"), "mean_tokens")  # a row per leaf
    scored = hits.join(F.broadcast(idf), "leaf")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens")))
    flat = scored.groupBy("id").agg((-F.sum(part)).alias("score"), *[F.max(F.col("leaf") == n).alias(f"has_{n}") for n in range(len(parts))])
    number = iter(range(len(parts)))

    def condition(node) -> Column:
        if isinstance(node, Q.Op):
            inner = [condition(p) for p in node.parts]
            if node.kind == "and":
                return reduce(lambda a, b: a & b, inner)
            if node.kind == "or":
                return reduce(lambda a, b: a | b, inner)
            return inner[0] & ~inner[1]
        return F.col(f"has_{next(number)}")

    return flat.where(condition(tree)).select("id", "score")


def search(messages: DataFrame, index: Index, query: str, condition: Column | None = None, limit: int = 100, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """Messages that match a query and a filter, best first (or newest first); an empty query finds nothing."""
    if not query.strip():
        return messages.where(F.lit(False)).withColumn("score", F.lit(0.0))
    rows = messages.where(condition) if condition is not None else messages
    found = rows.join(match(index, query), "id")
    order = [F.desc("date_unixtime"), F.col("id")] if newest_first else [F.col("score"), F.col("id")]
    return found.orderBy(*order).offset(offset).limit(limit)


def search_words(index: Index, words: list[str], every: bool) -> DataFrame:
    """Ids of the documents with every one, or any, of the words."""
    wanted = sorted({t for word in words for t in tokenize(word)})
    hits = index.of(wanted).where(F.col("term").isin(*wanted)).groupBy("id").agg(F.countDistinct("term").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("id") if every else hits.select("id")


def search_prefix(index: Index, prefix: str) -> DataFrame:
    """Ids of the documents with a word that starts so."""
    token = (tokenize(prefix) or [""])[0]
    return index.of([token]).where(F.col("term").startswith(token)).select("id").distinct() if token else index.table.select("id").distinct()


def keyword_fallback(messages: DataFrame, index: Index, query: str, limit: int = 20) -> DataFrame:
    """The newest messages with any word of more than two letters of a question."""
    words = [w for w in query.split() if len(w) > 2]
    return messages.join(search_words(index, words, every=False), "id", "left_semi").orderBy(F.desc("date_unixtime"), "id").limit(limit)


def first_words_alike(messages: DataFrame, index: Index, message_id: int, limit: int = 10) -> DataFrame:
    """The newest other messages with any of the first five words of a message."""
    own = messages.where(F.col("id") == message_id).select("text_plain").first()
    words = (own["text_plain"] or "").split()[:5] if own else []
    if not any(tokenize(w) for w in words):
        return messages.where(F.lit(False))
    return messages.join(search_words(index, words, every=False), "id", "left_semi").where(F.col("id") != message_id).orderBy(F.desc("date_unixtime"), "id").limit(limit)


def autocomplete(keys: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Keys under a prefix (column key, one row an insertion), by how many insertions have the key as their prefix; ties by key.

    Each key under the prefix is counted under all of its own prefixes at least as long, so no pairs are compared.
    """
    low = prefix.lower()
    under = keys.where("key is not null").select(F.lower("key").alias("key")).where(F.col("key").startswith(low)).groupBy("key").agg(F.count("*").alias("n"))
    heads = under.select(F.expr(f"explode(transform(sequence({max(len(low), 1)}, length(key)), i -> substring(key, 1, i)))").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("count"))
    return heads.join(under.select("key"), "key", "left_semi").orderBy(F.desc("count"), "key").limit(limit)


def trigram_postings(messages: DataFrame) -> DataFrame:
    """id, trigram, position in the sorted set of the text's trigrams, n_trigrams."""
    sets = messages.where("text_plain is not null").select("id", F.array_sort(trigrams(F.col("text_plain"))).alias("set"))
    return sets.select("id", F.size("set").alias("n_trigrams"), F.posexplode("set").alias("position", "trigram"))


def trigram_table(messages: DataFrame) -> DataFrame:
    """bucket, trigram, id, n_trigrams, position: the trigram postings as they are stored."""
    return bucketed(trigram_postings(messages), "trigram")


def fuzzy(postings: DataFrame, query: str, threshold: float = 0.3, limit: int = 50) -> DataFrame:
    """Messages whose trigram set overlaps the query's by at least ``threshold`` (Jaccard), best first; ties by id.

    ``postings`` is a ``trigram_table``, stored or not; only the trigrams of the query are read.
    """
    spark = postings.sparkSession
    asked = sorted(r[0] for r in spark.range(1).select(F.explode(trigrams(F.lit(query)))).collect())  # the trigrams of one query
    own = postings.where(F.col("bucket").isin(sorted({bucket_of(t) for t in asked})) & F.col("trigram").isin(asked)) if asked else postings.where(F.lit(False))
    shared = own.groupBy("id", "n_trigrams").agg(F.count("*").alias("c"))
    scored = shared.select("id", (F.col("c") / (F.lit(len(asked)) + F.col("n_trigrams") - F.col("c"))).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


@dataclass
class OkapiIndex:
    """terms: bucket, term, id, tf, n_tokens; documents: id, n_tokens; totals: n_docs, mean_tokens; idf: one row mean_idf over all terms."""

    terms: DataFrame
    documents: DataFrame
    totals: DataFrame
    mean_idf: DataFrame


def okapi_table(messages: DataFrame, min_length: int = 5) -> DataFrame:
    """bucket, term, id, tf, n_tokens of the messages with more than ``min_length`` characters."""
    words = messages.where(F.length("text_plain") > min_length).select("id", unicode_words(F.col("text_plain")).alias("words"))
    counted = words.select("id", F.size("words").cast("long").alias("n_tokens"), F.explode("words").alias("term")).groupBy("id", "n_tokens", "term").agg(F.count("*").alias("tf"))
    return bucketed(counted.select("term", "id", "tf", "n_tokens"), "term")


def okapi_documents(messages: DataFrame, min_length: int = 5) -> DataFrame:
    return messages.where(F.length("text_plain") > min_length).select("id", F.size(unicode_words(F.col("text_plain"))).cast("long").alias("n_tokens"))


def term_counts(terms: DataFrame) -> DataFrame:
    """term, n: how many documents have it; counts of parts add up."""
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def mean_idf(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: the mean idf of all terms."""
    return beside(counts, totals).agg(F.avg(F.ln(F.col("n_docs") - F.col("n") + 0.5) - F.ln(F.col("n") + 0.5)).alias("mean_idf"))


def okapi_index(messages: DataFrame, min_length: int = 5) -> OkapiIndex:
    """Word counts of the messages with more than ``min_length`` characters, in the query."""
    terms, documents = okapi_table(messages, min_length), okapi_documents(messages, min_length)
    totals = mean_totals(totals_of(documents))
    return OkapiIndex(terms, documents, totals, mean_idf(term_counts(terms), totals))


def okapi_many(index: OkapiIndex, queries: list[str]) -> DataFrame:
    """query (number), id, score above 0 by Okapi BM25 for several queries in one look-up.

    A repeated query word counts again; negative idf becomes a share of the mean idf of all words.
    """
    asked: dict[tuple[int, str], int] = {}
    for number, query in enumerate(queries):
        for token in re.findall(r"\w+", query.lower()):
            asked[number, token] = asked.get((number, token), 0) + 1
    terms = sorted({t for _, t in asked})
    own = index.terms.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms)) if terms else index.terms.where(F.lit(False))
    wanted = F.broadcast(index.terms.sparkSession.createDataFrame([(n, t, times) for (n, t), times in asked.items()], "query int, term string, times long"))
    raw = F.ln(F.col("n_docs") - F.col("n") + 0.5) - F.ln(F.col("n") + 0.5)
    idf = term_counts(own).transform(beside, index.totals).withColumn("idf", raw).transform(beside, index.mean_idf).select("term", "mean_tokens", F.when(F.col("idf") < 0, OKAPI_EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (OKAPI_K1 + 1) / (F.col("tf") + OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * F.col("n_tokens") / F.col("mean_tokens")))
    scored = own.join(F.broadcast(idf), "term").join(wanted, "term").groupBy("query", "id").agg(F.sum(part).alias("score"))
    return scored.where("score > 0")


def okapi(index: OkapiIndex, query: str, limit: int = 20) -> DataFrame:
    """id, score of the best messages of one query; ties by id."""
    return okapi_many(index, [query]).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)
