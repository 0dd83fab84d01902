"""Languages of texts and of the stretches of mixed texts, by error-correcting output codes over character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.lexicon import SHARED_WORDS, Words, fingerprint, with_known, word_set

LANGUAGES = ("en", "he", "ru", "uk", "es", "pt", "de", "fr", "ar")
LETTERS = 20
SAMPLE_PER_LANGUAGE = 1500
"""Labelled rows a language gives to the training sample, at most; the only sample taken here."""
SAMPLE_WORDS = 400
"""Words a sampled text trains with, taken at even distances from all over a longer one; classification reads whole texts."""
BITS = 15
BUCKETS = 1 << 16
SWITCH = 9.0
"""Loss a change of language must save."""
LOSS_PER_LETTER, LOSS_PER_WORD = 1.0, 7.0
"""A word speaks against a language with at most these losses, so a foreign name or short phrase doesn't part a text."""
# Codes and English names of the languages (two-letter, older two-letter, three-letter, bibliographic).
NAMES = {
    "en": "en eng english", "he": "he iw heb hebrew", "ru": "ru rus russian", "uk": "uk ukr ukrainian", "es": "es spa spanish castilian",
    "pt": "pt por portuguese", "de": "de deu ger german", "fr": "fr fra fre french", "ar": "ar ara arb arabic",
}
_NAMED = {name: code for code, names in NAMES.items() for name in names.split()}

_NO_TEXT = re.compile(
    r"(?:https?://|www\.)\S+|(?:mailto:)?[\w.+-]+(?: ?[@＠] ?|\s*[\[({]\s*at\s*[\])}]\s*)\w[\w-]*(?:(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*)\w[\w-]*)+|(?<![\w/])[@#/][\w-]+(?:@\w+)?|\b[\w-]+(?:\.[\w-]+)+/\S*",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+")


def named_language(label: str | None) -> str | None:
    """The language a label names in any case: a code, an older or longer code, a code with region, or an English name."""
    if label is None:
        return None
    return _NAMED.get(re.split(r"[-_\s]", label.strip().lower(), maxsplit=1)[0])


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs of letters outside links, handles, hashtags, commands and mail addresses."""
    if not text:
        return []
    if "@" in text or "/" in text or "#" in text or "at" in text or "＠" in text or "www." in text:
        text = _NO_TEXT.sub(" ", text)
    return _WORD.findall(text.lower())


def code_matrix(classes: int = len(LANGUAGES), bits: int = BITS, seed: int = 3) -> np.ndarray:
    """Codewords (classes x bits, -1 or 1) with the largest least distance of many random draws; every bit splits the classes."""
    random, best, best_gap = np.random.default_rng(seed), None, -1
    for _ in range(3000):
        code = random.choice([-1, 1], (classes, bits))
        if (np.abs(code.sum(0)) == classes).any():
            continue
        gap = min((code[a] != code[b]).sum() for a in range(classes) for b in range(a))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 4-grams of the words with their borders: feature numbers and the word each belongs to."""
    joined = "".join(f"\x02{word}\x03" for word in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(word) + 2 for word in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    features, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(n)
        mixed = rolled ^ (rolled >> np.uint64(23))
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        whole = owner[:size] == owner[n - 1 :]
        features.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[whole])
        owners.append(owner[:size][whole])
    return np.concatenate(features), np.concatenate(owners)


@dataclass
class Model:
    """weights: BUCKETS x BITS of the binary classifiers; code: the languages' codewords."""

    weights: np.ndarray
    code: np.ndarray

    def losses(self, words: list[str]) -> np.ndarray:
        """Loss of each language for each word: the logistic losses of its codeword's bits against the classifiers' margins."""
        if not words:
            return np.zeros((0, len(self.code)), np.float32)
        feature, owner = grams(words)
        order = np.argsort(owner, kind="stable")
        feature, owner = feature[order], owner[order]
        begins = np.searchsorted(owner, np.arange(len(words)))
        margins = np.add.reduceat(self.weights[feature], begins, axis=0)
        return np.logaddexp(0, -margins).astype(np.float32) @ (self.code.T == 1).astype(np.float32) + np.logaddexp(0, margins).astype(np.float32) @ (self.code.T == -1).astype(np.float32)


def _fit(words: list[str], counts: np.ndarray, code: np.ndarray, rounds: int) -> Model:
    """Logistic regressions, one a bit, on words with the share of each language among their uses."""
    feature, owner = grams(words)
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    begins = np.searchsorted(owner, np.arange(len(words)))
    total = counts.sum(1)
    target = (counts / total[:, None]) @ ((code + 1) / 2)
    weight = np.log1p(total)[:, None] / np.log1p(total).mean()
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    speed = np.full_like(weights, 1e-3)
    by_feature = np.argsort(feature, kind="stable")
    sorted_feature = feature[by_feature]
    heads = np.flatnonzero(np.r_[True, sorted_feature[1:] != sorted_feature[:-1]])
    used, owner_by_feature = sorted_feature[heads], owner[by_feature]
    for _ in range(rounds):
        margins = np.add.reduceat(weights[feature], begins, axis=0)
        error = ((target - 1 / (1 + np.exp(-margins))) * weight).astype(np.float32)
        step = np.add.reduceat(error[owner_by_feature], heads, axis=0) - 1e-3 * weights[used]
        speed[used] += step * step
        weights[used] += 0.35 * step / np.sqrt(speed[used])
    return Model(weights, code)


def train(texts: list[str | None], labels: list[str], rounds: int = 12) -> Model:
    """Fit on labelled texts some of which are labelled wrongly or mixed: after a first fit, only texts whose words agree with the label are kept."""
    code = code_matrix()
    bags = [letter_words(text) for text in texts]
    vocabulary: dict[str, int] = {}
    owners = np.fromiter((at for at, bag in enumerate(bags) for _ in bag), np.int64)
    tokens = np.fromiter((vocabulary.setdefault(word, len(vocabulary)) for bag in bags for word in bag), np.int64)
    words = list(vocabulary)
    if not words:
        return Model(np.zeros((BUCKETS, BITS), np.float32), code)
    given = np.array([LANGUAGES.index(label) for label in labels])
    keep = np.ones(len(bags), bool)
    model = None
    for n in (rounds // 2, rounds):
        counts = np.zeros((len(words), len(LANGUAGES)))
        used = keep[owners]
        np.add.at(counts, (tokens[used], given[owners[used]]), 1)
        seen = counts.sum(1) > 0
        model = _fit([w for w, s in zip(words, seen, strict=True) if s], counts[seen], code, n)
        loss = np.zeros((len(bags), len(LANGUAGES)))
        each = model.losses(words)
        np.add.at(loss, owners, each[tokens])
        best = each.argmin(1)
        agree = np.bincount(owners, weights=best[tokens] == given[owners], minlength=len(bags)) / np.maximum(np.bincount(owners, minlength=len(bags)), 1)
        keep = (loss.argmin(1) == given) & (agree > 0.6)
    return model


def training_sample(messages: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """The ``per_language`` labelled texts of each language with the smallest hashes, equal texts once; fewer only where there are no more.

    Each task keeps the best of its own rows, so a few rows per task and language are shuffled, whatever the table's size.
    """
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    label = names[F.split(F.lower(F.trim("lang")), r"[-_\s]")[0]]
    labelled = messages.where(F.col("lang").isNotNull() & (F.length("text_plain") >= LETTERS)).select(label.alias("label"), F.xxhash64("text_plain").alias("place"), F.col("text_plain").alias("text")).where("label is not null")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, str]] = {}
        last: dict[str, int] = {}
        for batch in batches:
            labels, places, texts = batch.column("label").dictionary_encode(), batch.column("place").to_numpy(), batch.column("text")
            codes = labels.indices.to_numpy()
            for code, name in enumerate(labels.dictionary.to_pylist()):
                mine, worst = held.setdefault(name, {}), last.get(name, np.iinfo(np.int64).max)
                for at in np.flatnonzero((codes == code) & (places <= worst)):
                    if (place := int(places[at])) not in mine:
                        words = letter_words(texts[int(at)].as_py())
                        mine[place] = " ".join(words[:: -(-len(words) // SAMPLE_WORDS) or 1])
                if len(mine) > 2 * per_language:
                    held[name] = {place: mine[place] for place in sorted(mine)[:per_language]}
                    last[name] = max(held[name])
        rows = [(name, place, mine[place]) for name, mine in held.items() for place in sorted(mine)[:per_language]]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["label", "place", "text"])

    kept = labelled.mapInArrow(best, "label string, place long, text string").groupBy("label", "place").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    rows_taken = kept.withColumn("nth", nth).where(F.col("nth") <= per_language).orderBy("label", "nth").collect()
    return [r.text for r in rows_taken], [r.label for r in rows_taken]


def _paths(cost: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text (consecutive rows of ``cost``) the cheapest sequence of languages, a change costing SWITCH; all texts at once."""
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    lengths = lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    state = np.zeros((len(lengths), cost.shape[1]), np.float32)
    back = np.empty(cost.shape, np.int8)
    own = np.arange(cost.shape[1], dtype=np.int8)
    for t, n in enumerate(active):
        now = state[:n]
        cheapest = now.argmin(1)
        entry = now[np.arange(n), cheapest] + SWITCH
        stay = now <= entry[:, None]
        at = first[:n] + t
        back[at] = np.where(stay, own, cheapest[:, None])
        state[:n] = np.where(stay, now, entry[:, None]) + cost[at]
    path = np.empty(len(cost), np.int8)
    language = state.argmin(1).astype(np.int8)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = language[:n]
        language[:n] = back[at, language[:n]]
    return path


def _merged(runs: list[list]) -> list[list]:
    """Runs [language, letters, first word, end] with those shorter than LETTERS given to the stretch around them, shortest first."""

    def join_equal(parts: list[list]) -> list[list]:
        out = [parts[0]]
        for part in parts[1:]:
            if part[0] == out[-1][0]:
                out[-1] = [part[0], out[-1][1] + part[1], out[-1][2], part[3]]
            else:
                out.append(part)
        return out

    runs = join_equal(runs)
    while len(runs) > 1:
        short = [i for i in range(len(runs)) if runs[i][1] < LETTERS]
        if not short:
            break
        enclosed = [i for i in short if 0 < i < len(runs) - 1 and runs[i - 1][0] == runs[i + 1][0]]
        at = min(enclosed or short, key=lambda i: runs[i][1])
        beside = [i for i in (at - 1, at + 1) if 0 <= i < len(runs)]
        host = max(beside, key=lambda i: (runs[i][1], -i))
        runs[at] = [runs[host][0], *runs[at][1:]]
        runs = join_equal(runs)
    return runs


def name_words(names: DataFrame, column: str) -> DataFrame:
    """word: the words of a column of personal names."""
    return names.select(F.explode(F.split(F.lower(column), r"[^\p{L}]+")).alias("word")).where(F.length("word") > 2).distinct()


def classify(model: Model, texts: list[str | None], names: Words | None = None) -> pd.DataFrame:
    """row, segment_no, lang, n_letters, confidence, ambiguous of the segments of the texts with at least LETTERS letters.

    The words of ``names`` speak for no language.
    """
    bags = [letter_words(text) for text in texts]
    letters = np.fromiter((sum(map(len, bag)) for bag in bags), np.int64, len(bags))
    rows = np.flatnonzero(letters >= LETTERS)
    flat = [word for row in rows for word in bags[row]]
    out: dict[str, list] = {k: [] for k in ("row", "segment_no", "lang", "n_letters", "confidence", "ambiguous")}
    if flat:
        token, words = pd.factorize(np.array(flat, object))
        loss = model.losses(list(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        loss = np.minimum(loss - loss.min(1, keepdims=True), np.minimum(LOSS_PER_LETTER * sizes, LOSS_PER_WORD)[:, None]).astype(np.float32)
        if names is not None:
            loss[names.among(words)] *= 0.1
        size, cost = sizes[token], loss[token]
        lengths = np.fromiter((len(bags[row]) for row in rows), np.int64, len(rows))
        path = _paths(cost, lengths)
        sums = np.vstack([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        change = np.flatnonzero(path[1:] != path[:-1]) + 1
        borders = np.unique(np.concatenate([begin, change]))
        text_of = np.searchsorted(begin, borders[:-1], "right") - 1
        weight = np.add.reduceat(size, borders[:-1])
        by_text = np.searchsorted(text_of, np.arange(len(rows) + 1))
        lang_of = path[borders[:-1]]
        for at, row in enumerate(rows):
            a, b = by_text[at], by_text[at + 1]
            if b - a == 1:
                runs = [[lang_of[a], weight[a], borders[a], borders[b]]]
            else:
                runs = _merged([[lang_of[i], weight[i], borders[i], borders[i + 1]] for i in range(a, b)])
            for number, (language, count, first, end) in enumerate(runs, 1):
                mean = (sums[end] - sums[first]) / np.sqrt(end - first)
                share = np.exp(mean.min() - mean)
                confidence = share[language] / share.sum()
                for key, value in zip(out, (row, number, LANGUAGES[language], count, confidence, confidence < 0.6), strict=True):
                    out[key].append(value)
    return pd.DataFrame(out)


def language_segments(messages: DataFrame, key: str = "delivery_id", model: Model | None = None, shared_words: int = SHARED_WORDS) -> DataFrame:
    """Segments of every text: key, segment_no, lang, n_letters, confidence, ambiguous, named (the language the label names), n_segments.

    A segment is a longest stretch in one of LANGUAGES with at least LETTERS letters; shorter stretches belong to the stretch
    around them. Texts with fewer letters, null or empty ones have none. A null key stays null; equal rows are all reported.
    Without ``model`` one is trained on a bounded sample of the table's labelled rows; a table without labels gets a model
    that can't tell languages apart, with even confidence. Words of from_name, if the table has it, speak for no language; a
    set of more than ``shared_words`` of them is joined with the words of the texts instead of sent to the tasks.
    """
    if model is None:
        model = train(*training_sample(messages))
    names = word_set(name_words(messages, "from_name"), limit=shared_words) if "from_name" in messages.columns else None
    joined = isinstance(names, DataFrame)
    shared = messages.sparkSession.sparkContext.broadcast((model.weights, model.code, None if joined else names))
    kind = messages.schema[key].dataType.simpleString()

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, names = Model(*shared.value[:2]), shared.value[2]
        for batch in batches:
            if not len(batch):
                continue
            if joined:
                known = [Words(np.array([] if marks is None else marks, np.int64)) for marks in batch.known]
                parts = [classify(own, [text], of).assign(row=row) for row, (text, of) in enumerate(zip(batch.text_plain, known, strict=True))]
                found = pd.concat(parts, ignore_index=True)
            else:
                found = classify(own, batch.text_plain.tolist(), names)
            if not len(found):
                continue
            at = found.row.to_numpy(np.int64)
            label, distinct = pd.factorize(batch.lang, use_na_sentinel=False)
            named = np.array([named_language(x if isinstance(x, str) else None) for x in distinct], object)[label]
            many = np.bincount(at, minlength=len(batch))
            yield pd.DataFrame({
                key: batch[key].to_numpy()[at], "segment_no": found.segment_no.to_numpy(np.int64), "lang": found.lang, "n_letters": found.n_letters.to_numpy(np.int64),
                "confidence": found.confidence.to_numpy(float), "ambiguous": found.ambiguous.to_numpy(bool), "named": named[at], "n_segments": many[at],
            })

    schema = f"{key} {kind}, segment_no long, lang string, n_letters long, confidence double, ambiguous boolean, named string, n_segments long"
    rows = messages.select(key, "text_plain", "lang")
    if joined:
        rows = with_known(rows, "text_plain", lambda text: map(fingerprint, letter_words(text)), names)
    return rows.mapInPandas(segment, schema)


def wrong_labels(segments: DataFrame) -> DataFrame:
    """The segments of rows that have several, or whose label doesn't name their language."""
    return segments.where((F.col("n_segments") > 1) | ~F.col("named").eqNullSafe(F.col("lang")))
