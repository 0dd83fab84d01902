"""Writing styles: features per author, similarity of authors, clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import split_words
from chatlake.functions.time import parsed
from chatlake.operators.threads import connected_components
from chatlake.session import settle

# Word lists and character classes of the features.
FUNCTION_WORDS = (
    "של את על עם אל מן בין לפני אחרי תחת אני אתה את הוא היא אנחנו אתם אתן הם הן זה זאת זו אלה אלו כי אם או גם רק אבל אלא למרות בגלל כדי "
    "מה מי איפה מתי למה איך כמה כל הרבה קצת מאוד יותר פחות כמו לא כן אין יש היה להיות עוד כבר"
).split()
FORMAL = ["אנוכי", "הנני", "עליכם", "בבקשה", "תודה רבה", "בכבוד רב", "לכבוד"]
INFORMAL = ["אחי", "גבר", "אחלה", "סבבה", "יאללה", "וואלה", "באסה", "חחחח", "חחח", "לול", "wtf", "omg"]
SLANG = "אחלה סבבה יאללה וואלה באסה חבל מגניב אשכרה חחחח חחח הההה ממממ אההה נו טוב בסדר פיצוץ משהו כאילו סתם ממש פשוט נורא מלא".split()
ACRONYMS = ["בעזהש", "אכא", "נלענד", "תנצבה", "זצל", 'בס"ד', 'בע"ה', 'אי"ה', 'בל"נ']
EMOJI_RUN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
# Divisors (below 1: multipliers) that bring the features to one scale.
SCALES = {
    "avg_message_length": 200, "std_message_length": 100, "avg_word_length": 10, "avg_words_per_message": 20, "hebrew_ratio": 1, "english_ratio": 1, "digit_ratio": 1 / 10, "emoji_ratio": 1 / 100, "punctuation_ratio": 1 / 10,
    "comma_rate": 2, "period_rate": 2, "question_rate": 1, "exclamation_rate": 1, "ellipsis_rate": 1 / 5, "quote_rate": 1, "formality_score": 1, "slang_rate": 1 / 5, "acronym_rate": 1 / 10, "repeated_chars_rate": 1 / 5,
    "leet_speak_rate": 1 / 10, "unique_word_ratio": 1, "hapax_ratio": 1, "short_message_ratio": 1, "long_message_ratio": 1, "weekend_ratio": 1, "night_owl_ratio": 1 / 5,
}
N_FUNCTION_WORDS = 20
TOP_BIGRAMS, TOP_TRIGRAMS, TOP_WORD_BIGRAMS = 100, 100, 50
# Weights and steps of the similarity of two authors.
W_FEATURES, W_BIGRAMS, W_TRIGRAMS, W_EMBEDDING = 0.50, 0.30, 0.10, 0.10
STEPS = ((0.96, 1.15), (0.94, 1.0), (0.90, 0.75))
FAR = 0.5
BIGRAM_LOW, BIGRAM_HIGH = (0.80, 0.85), (0.85, 1.05)
EPS = 0.5
BLOCK_AUTHORS = 256


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _any(text: Column, parts: list[str]) -> Column:
    """How many of the parts a text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in parts])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scalar_features(messages: DataFrame) -> DataFrame:
    """from_id and the scalar features of each author (from_id, text_plain, date); null and empty texts count as messages but have no text.

    Ratios are over the characters of all texts joined by single spaces. One aggregation over the messages, one over the
    distinct words, one over the hours; all combine before the exchange.
    """
    text = F.coalesce("text_plain", F.lit(""))
    has = text != ""
    words = split_words(text)
    n_words = F.size(words)
    rows = messages.where(F.col("from_id").isNotNull() & (F.col("from_id") != ""))
    shown = rows.select(
        "from_id", has.cast("int").alias("has"), F.when(has, F.length(text)).alias("len"), F.when(has, n_words).alias("words"), F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).alias("word_chars"),
        _count(text, r"[\x{0590}-\x{05FF}]").alias("hebrew"), _count(text, "[a-zA-Z]").alias("english"), _count(text, r"(?U)\d").alias("digits"), _count(text, r"[.,!?;:()\[\]{}]").alias("punct"), _count(text, EMOJI_RUN).alias("emoji"),
        *[_count(text, p).alias(n) for n, p in (("comma", ","), ("period", r"\."), ("question", r"\?"), ("exclamation", "!"), ("ellipsis", r"\.\.\."), ("quote", "[\"']"))],
        *[F.contains(text, F.lit(p)).cast("int").alias(f"formal_{i}") for i, p in enumerate(FORMAL)], *[F.contains(F.lower(text), F.lit(p)).cast("int").alias(f"informal_{i}") for i, p in enumerate(INFORMAL)],
        _any(text, SLANG).alias("slang"), _any(text, ACRONYMS).alias("acronym"), text.rlike(r"(.)\1{2,}").cast("int").alias("repeated"), _count(text, r"(?U)\b\w*\d+\w*\b").alias("leet"),
        F.when(has & (n_words < 5), 1).otherwise(0).alias("short"), F.when(has & (n_words > 30), 1).otherwise(0).alias("long"), parsed(F.col("date")).alias("at"),
    )
    shown = shown.withColumn("hour", F.hour("at")).withColumn("weekday", F.weekday("at"))
    sums = ["has", "words", "word_chars", "hebrew", "english", "digits", "punct", "emoji", "comma", "period", "question", "exclamation", "ellipsis", "quote", "slang", "acronym", "repeated", "leet", "short", "long"]
    per = shown.groupBy("from_id").agg(
        F.count("*").alias("n_messages"), F.avg("len").alias("avg_message_length"), F.stddev_pop("len").alias("std_message_length"), F.sum("len").alias("chars"), F.avg("words").alias("avg_words_per_message"),
        *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.max(f"formal_{i}").alias(f"formal_{i}") for i in range(len(FORMAL))], *[F.max(f"informal_{i}").alias(f"informal_{i}") for i in range(len(INFORMAL))],
        F.count_if(F.col("weekday") >= 5).alias("weekend"), F.count_if(F.col("hour") < 6).alias("night"), F.count("at").alias("dated"),
        *[F.count_if(F.col("hour") == h).alias(f"hour_{h}") for h in range(24)], *[F.count_if(F.col("weekday") == d).alias(f"day_{d}") for d in range(7)],
    )
    used = rows.select("from_id", F.explode(F.transform(words, F.lower)).alias("word")).groupBy("from_id", "word").agg(F.count("*").alias("n"))
    wanted = list(dict.fromkeys(FUNCTION_WORDS))
    vocabulary = used.groupBy("from_id").agg(F.count("*").alias("distinct"), F.count_if(F.col("n") == 1).alias("hapax"), *[F.coalesce(F.max(F.when(F.col("word") == w, F.col("n"))), F.lit(0)).alias(f"fw_{i}") for i, w in enumerate(wanted)])
    both = per.join(vocabulary, "from_id", "left").na.fill(0)
    total = F.col("chars") + F.greatest(F.col("sum_has") - 1, F.lit(0))
    formal = reduce(lambda a, b: a + b, [F.col(f"formal_{i}") for i in range(len(FORMAL))])
    informal = reduce(lambda a, b: a + b, [F.col(f"informal_{i}") for i in range(len(INFORMAL))])
    n = F.col("n_messages")
    words_total = F.greatest(F.lit(1), F.col("sum_words"))
    return both.select(
        "from_id", "n_messages", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_message_length", "std_message_length", "avg_words_per_message")], _ratio(F.col("sum_word_chars"), F.col("sum_words")).alias("avg_word_length"),
        *[_ratio(F.col(f"sum_{c}"), total).alias(name) for c, name in (("hebrew", "hebrew_ratio"), ("english", "english_ratio"), ("digits", "digit_ratio"), ("punct", "punctuation_ratio"), ("emoji", "emoji_ratio"))],
        *[(F.col(f"sum_{c}") / n).alias(f"{c}_rate") for c in ("comma", "period", "question", "exclamation", "ellipsis", "quote", "slang", "acronym")],
        _ratio((formal - informal).cast("double"), formal + informal).alias("formality_score"), (F.col("sum_repeated") / n).alias("repeated_chars_rate"), (F.col("sum_leet") / n).alias("leet_speak_rate"),
        (F.col("distinct") / words_total).alias("unique_word_ratio"), (F.col("hapax") / F.greatest(F.lit(1), F.col("distinct"))).alias("hapax_ratio"), (F.col("sum_short") / n).alias("short_message_ratio"),
        (F.col("sum_long") / n).alias("long_message_ratio"), (F.col("weekend") / n).alias("weekend_ratio"), (F.col("night") / n).alias("night_owl_ratio"),
        F.array(*[_ratio(F.col(f"hour_{h}"), F.col("dated")) for h in range(24)]).alias("hours"), F.array(*[_ratio(F.col(f"day_{d}"), F.col("dated")) for d in range(7)]).alias("weekdays"),
        F.array(*[F.col(f"fw_{wanted.index(w)}") / words_total for w in FUNCTION_WORDS]).alias("function_words"),
    )


def feature_vector(features: DataFrame) -> DataFrame:
    """from_id, vector: scaled scalars, hours, weekdays and the first function words (77 numbers)."""
    scaled = [F.col(name) / divisor for name, divisor in SCALES.items()]
    words = F.transform(F.slice("function_words", 1, N_FUNCTION_WORDS), lambda x: x * 100)
    return features.select("from_id", F.concat(F.array(*scaled), "hours", "weekdays", words).alias("vector"))


def ngrams(messages: DataFrame, kind: str) -> DataFrame:
    """from_id, gram, share of an author's most used character bigrams, trigrams or word bigrams; shares are over all of them, ties by gram."""
    text = F.lower(F.coalesce("text_plain", F.lit("")))
    if kind == "word_bigrams":
        words = split_words(text)
        grams, most = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)), TOP_WORD_BIGRAMS
    else:
        size, most = (2, TOP_BIGRAMS) if kind == "bigrams" else (3, TOP_TRIGRAMS)
        clean = F.regexp_replace(text, r"(?U)\s+", " ")
        grams = F.regexp_extract_all(clean, F.lit(f"(?s)(?=(\\P{{Cs}}.{{{size - 1}}}))"), F.lit(1))
    rows = messages.where(F.col("from_id").isNotNull() & (F.col("from_id") != "")).select("from_id", F.explode(grams).alias("gram")).where(F.trim("gram") != "")
    counts = rows.groupBy("from_id", "gram").agg(F.count("*").alias("n"))
    totals = counts.groupBy("from_id").agg(F.sum("n").alias("total"))
    nth = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= most).join(totals, "from_id").select("from_id", "gram", (F.col("n") / F.col("total")).alias("share"))


def profiles(messages: DataFrame, min_messages: int = 300) -> DataFrame:
    """One row per active author: from_id, n_messages, scalar features, vector, and maps bigrams, trigrams, word_bigrams (bounded by their tops)."""
    counts = messages.where(F.col("text_plain") != "").groupBy("from_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_messages)
    active = messages.where(F.col("text_plain") != "").join(counts.select("from_id"), "from_id", "left_semi")
    features = settle(scalar_features(active))
    whole = features.join(feature_vector(features), "from_id")
    for kind in ("bigrams", "trigrams", "word_bigrams"):
        maps = ngrams(active, kind).groupBy("from_id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "share"))).alias(kind))
        whole = whole.join(maps, "from_id", "left")
    return whole


def weighted_jaccard(a: dict | None, b: dict | None) -> float:
    """Sum of the smaller over the sum of the larger shares; 0 if either is empty."""
    if not a or not b:
        return 0.0
    keys = a.keys() | b.keys()
    most = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / most if most else 0.0


def overall(features: float, bigrams: float, trigrams: float, embedding: float | None = None) -> float:
    """The similarity of two authors from their parts, at most 1."""
    base = W_FEATURES * features + W_BIGRAMS * bigrams + W_TRIGRAMS * trigrams + (W_EMBEDDING * embedding if embedding is not None else 0)
    factor = next((f for least, f in STEPS if features >= least), FAR)
    if bigrams < BIGRAM_LOW[0]:
        factor *= BIGRAM_LOW[1]
    elif bigrams >= BIGRAM_HIGH[0]:
        factor *= BIGRAM_HIGH[1]
    return min(base * factor, 1.0)


def explanations(a: dict, b: dict, scores: dict) -> list[str]:
    """Which traits two authors share, by fixed thresholds."""

    def apart(name: str) -> float:
        return abs(a[name] - b[name])

    rules = [
        ("embedding", (scores.get("embedding") or 0) > 0.85), ("message length", apart("avg_message_length") < 15), ("hebrew share", apart("hebrew_ratio") < 0.1),
        ("emoji", apart("emoji_ratio") < 0.005 and max(a["emoji_ratio"], b["emoji_ratio"]) > 0.001), ("formal", apart("formality_score") < 0.3 and a["formality_score"] > 0.3),
        ("informal", apart("formality_score") < 0.3 and a["formality_score"] < -0.3), ("slang", apart("slang_rate") < 0.1 and a["slang_rate"] > 0.2),
        ("repeated characters", apart("repeated_chars_rate") < 0.05 and a["repeated_chars_rate"] > 0.1), ("hours", scores.get("hours", 0) > 0.8), ("weekends", apart("weekend_ratio") < 0.1),
        ("nights", apart("night_owl_ratio") < 0.05 and a["night_owl_ratio"] > 0.1), ("letter pairs", scores.get("bigrams", 0) > 0.6), ("word pairs", scores.get("word_bigrams", 0) > 0.4),
    ]
    return [name for name, holds in rules if holds]


def _block_pairs(rows: DataFrame, n: int) -> DataFrame:
    """Rows with the pairs of blocks (pair, side) they take part in; a pair of blocks holds a bounded number of authors."""
    blocks = max(1, -(-n // BLOCK_AUTHORS))
    own = F.pmod(F.xxhash64("from_id"), F.lit(blocks)).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.withColumn("pair", F.least("own", "other") * blocks + F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))


def least_features(threshold: float) -> float:
    """The smallest feature cosine with which two authors can reach a similarity, all other parts being 1."""
    steps = [*STEPS, (-1.0, FAR)]
    for low, factor in reversed(steps):
        high = next((least for least, f in reversed(STEPS) if least > low), 1.0)
        if overall(high - 1e-12, 1.0, 1.0) >= threshold or overall(low, 1.0, 1.0) >= threshold:
            return low
    return 2.0


def similar_authors(found: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs user_1 < user_2 of ``profiles`` with their similarity, its parts and the traits they share, at least ``threshold``.

    Authors meet block by block; one product of matrices gives the feature cosines of a pair of blocks, and only pairs whose
    cosine can reach the threshold are compared further, by aligned columns of shares.
    """
    found = settle(found)
    kinds = ("bigrams", "trigrams", "word_bigrams")
    columns = ["from_id", "vector", "hours", *kinds]
    least = least_features(threshold)

    def aligned(maps: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        places: dict[str, int] = {}
        rows = [dict(m) if m is not None else {} for m in maps]
        for row in rows:
            for gram in row:
                places.setdefault(gram, len(places))
        out = np.zeros((len(rows), max(1, len(places))))
        for i, row in enumerate(rows):
            out[i, [places[g] for g in row]] = list(row.values())
        return out, out.sum(1)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("from_id").reset_index(drop=True)
        side = part.side.to_numpy()
        unit = np.array(part.vector.tolist(), float)
        lengths = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, lengths, out=np.zeros_like(unit), where=lengths > 0)
        cosines = unit @ unit.T
        wanted = np.triu(cosines >= least - 1e-9, 1)
        if side.any() and not side.all():
            wanted &= side[:, None] != side[None, :]
        hours = np.array(part.hours.tolist(), float)
        tables = {k: aligned(part[k]) for k in kinds}
        out = []
        for i in np.flatnonzero(wanted.any(1)):
            others = np.flatnonzero(wanted[i])
            parts = {}
            for k, (shares, sums) in tables.items():
                both = np.minimum(shares[i], shares[others]).sum(1)
                most = sums[i] + sums[others] - both
                parts[k] = np.divide(both, most, out=np.zeros(len(others)), where=(most > 0) & (sums[i] > 0) & (sums[others] > 0))
            for at, j in enumerate(others):
                values = [float(parts[k][at]) for k in kinds]
                score = overall(float(cosines[i, j]), *values[:2])
                if score >= threshold:
                    out.append((part.from_id[i], part.from_id[j], score, float(cosines[i, j]), *values, float(hours[i] @ hours[j])))
        return pd.DataFrame(out, columns=["user_1", "user_2", "similarity", "features", *kinds, "hours"])

    pairs = _block_pairs(found.select(*columns), found.count())
    schema = "user_1 string, user_2 string, similarity double, features double, bigrams double, trigrams double, word_bigrams double, hours double"
    return pairs.groupBy("pair").applyInPandas(compare, schema)


TRAITS = ("avg_message_length", "hebrew_ratio", "emoji_ratio", "formality_score", "slang_rate", "repeated_chars_rate", "weekend_ratio", "night_owl_ratio")


def explained(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of ``similar_authors`` with ``shared``: the traits both have, by the rules of ``explanations``, as an array."""
    own = found.select("from_id", F.struct(*TRAITS).alias("traits"))
    joined = pairs.join(own.toDF("user_1", "a"), "user_1").join(own.toDF("user_2", "b"), "user_2")

    @F.pandas_udf("array<string>")
    def shared(a: pd.DataFrame, b: pd.DataFrame, hours: pd.Series, bigrams: pd.Series, word_bigrams: pd.Series) -> pd.Series:
        rows = zip(a.to_dict("records"), b.to_dict("records"), hours, bigrams, word_bigrams, strict=True)
        return pd.Series([explanations(x, y, {"hours": h, "bigrams": g, "word_bigrams": w}) for x, y, h, g, w in rows])

    return joined.withColumn("shared", shared("a", "b", "hours", "bigrams", "word_bigrams")).drop("a", "b")


def clusters(found: DataFrame, eps: float = EPS) -> DataFrame:
    """from_id, cluster (its smallest member) of the authors within ``eps`` cosine distance in standardised features.

    With two members as the least cluster, density clustering is the same as the components of the graph of close pairs.
    """
    found = settle(found.select("from_id", "vector"))
    places = found.select(F.posexplode("vector").alias("place", "x"))
    norms = {r.place: (r.mean, r.sd or 1.0) for r in places.groupBy("place").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()}  # a row per feature
    mean, sd = np.array([norms[i][0] for i in range(len(norms))]), np.array([norms[i][1] for i in range(len(norms))])

    def close(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("from_id").reset_index(drop=True)
        unit = (np.array(part.vector.tolist(), float) - mean) / sd
        lengths = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, lengths, out=np.zeros_like(unit), where=lengths > 0)
        i, j = np.nonzero(np.triu(unit @ unit.T >= 1 - eps, 1))
        return pd.DataFrame({"a": part.from_id.to_numpy()[i], "b": part.from_id.to_numpy()[j]})

    edges = _block_pairs(found, found.count()).groupBy("pair").applyInPandas(close, "a string, b string").distinct()
    return connected_components(edges).select(F.col("node").alias("from_id"), F.col("component").alias("cluster"))


def style_samples(messages: DataFrame) -> DataFrame:
    """from_id and the text an encoder gets for an author: the first hundred messages joined, 5000 characters."""
    nth = F.row_number().over(Window.partitionBy("from_id").orderBy("date_unixtime", "id"))
    first = messages.where(F.col("text_plain") != "").withColumn("nth", nth).where(F.col("nth") <= 100)
    parts = F.array_sort(F.collect_list(F.struct("nth", "text_plain")))
    return first.groupBy("from_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text_plain"]), " "), 1, 5000).alias("text"))

