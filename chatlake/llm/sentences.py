"""Sentence boundaries by character properties, with abbreviations per language and quotations kept together."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

# Abbreviations per language (without their last dot, lower case) after which a sentence goes on whatever follows.
NEVER_LAST = {
    "en": "dr mr mrs ms messrs prof gen col capt cpt lt sgt maj adm rev hon sen rep gov pres st mt ft i.e e.g cf vs viz approx ca esp incl",
    "es": "dr sr sra srta dra dres dña d. avda av ud uds aprox núm pág págs p.ej ej p.e prof gral",
    "pt": "dr sr sra srª srta dra prof profª ex exª av aprox pág p.ex",
    "de": "dr hr hrn fr dipl ing prof st z.b d.h u.a i.d.r s.o s.u vgl bzw inkl evtl ggf ca geb gest sog zzgl",
    "fr": "dr mm mme mlle mgr me prof cf env c.-à-d chap éd st ste av",
    "ru": "ул пер просп пр-т пл наб им проф акад доц гр тов т.е т.к т.н напр см ср св рис табл",
    "uk": "вул просп пл ім проф акад доц див напр т.зв ул пер наб",
    "he": "ש'",
    "ar": "أ د م",
    "hi": "डॉ श्री श्रीमती प्रो",
}
# Abbreviations per language that stand before a number and end a sentence only when no number follows.
BEFORE_NUMBER = {
    "en": "no nos p pp fig figs vol vols sec art ch ed eq max min",
    "es": "n.º núm pág págs art cap tel vol fig p pp no nos",
    "pt": "n.º núm pág art cap tel vol fig p pp no",
    "de": "nr nrn bd abb kap s art tel d max min p",
    "fr": "n.º art chap vol fig p pp no nos tél",
    "ru": "д кв стр гл ст г к т рис",
    "uk": "д кв стр гл ст к т буд",
    "hi": "नं सं",
}
# Abbreviations per language that end a sentence when the next word starts one.
MAYBE_LAST = {
    "en": "etc inc ltd co corp bros pct al jr sr ave blvd rd jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun a.m p.m u.s u.k u.n ph.d b.a m.a d.c hrs hr mins ret est dept",
    "es": "etc al ee.uu a.m p.m jr hr cía",
    "pt": "etc al a.m p.m jr cia",
    "de": "etc usw usf u.dgl uhr jh str ff al jan feb mar apr jun jul aug sep sept okt nov dez",
    "fr": "etc al janv févr avr juil sept oct nov déc",
    "ru": "и.т.д т.д т.п др пр руб коп тыс млн млрд г гг в вв н.э",
    "uk": "т.д т.п ін грн тис млн млрд р рр ст н.е",
}
# Abbreviations that are ordinary words as well; before a frequent word they end a sentence.
ORDINARY = frozenset("им ex col rep sen hon fr me st prof sec art fig".split())
# Frequent short words that tell the languages of one script apart.
TELLING = {
    "en": "the and of to is are was were in on with for that this not you we he she they it from his her had have has who what there please still before after then nobody everyone",
    "es": "el la los las y de que en con para no es se un una por está pero más lo del al como nos ya quién",
    "pt": "o os as e de que em com para não é se um uma por está mas mais do da no na como já quem",
    "de": "der die das und ist nicht mit für auf ein eine wir ich sie er zu den dem von im es bei nach noch hat",
    "fr": "le les des et est pas avec pour une un nous je il elle à de la du au dans sur qui ne se ce",
    "ru": "и в не на что с как это по но из за от для мы он она они уже ещё все был была у к потом затем тогда",
    "uk": "і в не на що з як це по але із за від для ми він вона вони вже ще всі був була у та є",
}
# Words before a single letter that make it the initial of a name.
BEFORE_INITIAL = frozenset("and by with via from for to of dear und von bei mit für an y de con por para et avec chez pour par и с от к у для".split())
# Words before a German ordinal.
BEFORE_ORDINAL = frozenset("am dem den der des vom zum bis im ab seit beim die das".split())
# Verbs of saying that follow quoted speech, and words that carry a sentence on after it, in Chinese.
SAID_ZH = ("写道", "说道", "问道", "答道", "笑道", "喊道", "回答", "说", "问", "道", "答", "喊", "叫")
ON_ZH = ("然后", "就", "便", "而后", "接着", "随后", "并")
# Particles that carry a Japanese sentence on after quoted speech.
ON_JA = ("と", "って", "など", "は", "が", "を", "に", "も", "の", "で", "や")

_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
_FIRM = "".join(c for c in regex.findall(r"\p{SB=STerm}", _ALL) if c not in "․‥")
_SOFT = "".join(regex.findall(r"\p{SB=ATerm}", _ALL)) + "‥…"
_CLOSE = "".join(c for c in regex.findall(r"\p{SB=Close}", _ALL)) + "*_"
_BEHIND = frozenset(_CLOSE + " \xa0\u202f")
_OPENING = "“«„‘‹「『《〈（([{【〔¿¡\"'*_"
_WIDE = "。！？｡．"

_LINE = re.compile("[^\n\r\x0b\x0c\x85  ]+")
_MARK = re.compile("[" + re.escape(_FIRM + _SOFT) + "]+")
_HIDDEN = regex.compile(r"[\s\p{Z}\p{Cc}\p{Cf}]*")
_EMOJI = regex.compile(r"(?:[\p{Extended_Pictographic}\p{Emoji_Presentation}\p{Regional_Indicator}][︎️⃣]?\p{Emoji_Modifier}?(?:‍\p{Extended_Pictographic}️?\p{Emoji_Modifier}?)*)+|(?::-?[)(DP]|;-?\)|\){2,})(?=\s|$)")
_PREFIX = regex.compile(r"\s*(?:(?:[>#*•◦▪‣·–—-]+|\d{1,4}[.)](?!\d)|\(?[a-zA-Zа-я]\)|\[[^\]\n]{1,120}\]:?)\s+)*")
_THAI = re.compile("[฀-๿]")
_SPACES = re.compile(r"\s+")
_GLUED = re.compile(r"(?<=[^\W\d_A-Z][^\W\d_A-Z])\.(?=[^\W\d_a-z])|(?<=[!?…])")
_PART = re.compile(r"[\s([{«„“\"「『—–/]")
_SPACE = re.compile(r"\s")
AROUND = 70
"""Characters on either side of a mark that tell its language."""
LONGEST = 64
"""Longer runs without spaces are no abbreviations; only this much of their end is looked at."""
_THAI_SHORT = re.compile("[฀-๿]{1,4}\\.")
_LISTS = [{lang: frozenset(words.split()) for lang, words in table.items()} for table in (NEVER_LAST, BEFORE_NUMBER, MAYBE_LAST)]
_KNOWN = [frozenset().union(*lists.values()) for lists in _LISTS]
_NEVER, _NUMBER, _MAYBE = range(3)
_TELLING = {lang: frozenset(words.split()) for lang, words in TELLING.items()}
_SCRIPTS = (("en", "es", "pt", "de", "fr"), ("ru", "uk"))
_RUN = re.compile(r"[^\W\d_]+")
_PAIRS = {"“": "”", "«": "»", "„": "“”", "‹": "›", "「": "」", "『": "』", "《": "》"}
_QUOTE = re.compile("[“«„‹「『《\"]")


def language_of(text: str, script: tuple[str, ...]) -> str | None:
    """The language among those of one script whose frequent words the text has most of; None if none is two ahead."""
    words = [word for word in _RUN.findall(text.lower()) if len(word) > 1 or not word.isascii()]
    counts = sorted(((sum(map(_TELLING[lang].__contains__, words)), lang) for lang in script), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] + 1 else None


class _Line:
    """One line of a document, with what its boundaries ask for again and again found once."""

    def __init__(self, text: str, ends: list[int]) -> None:
        self.text, self.ends = text, ends
        self.parts = [m.start() for m in _PART.finditer(text)]
        self.spaces = [m.start() for m in _SPACE.finditer(text)]

    def token(self, mark: int) -> tuple[int, str]:
        """Start of the run of characters before ``mark``, and the run, of which a long one gives its end."""
        at = bisect_left(self.parts, mark)
        start = self.parts[at - 1] + 1 if at else 0
        return start, self.text[max(start, mark - LONGEST) : mark]

    def word_before(self, mark: int) -> str:
        """The word before the one at ``mark``, spaces between; a long one is cut in the middle."""
        at = bisect_left(self.spaces, mark)
        while at > 1 and self.spaces[at - 2] == self.spaces[at - 1] - 1:
            at -= 1
        if not at:
            return ""
        end = self.spaces[at - 1]
        start = self.spaces[at - 2] + 1 if at > 1 else 0
        return self.text[start:end] if end - start <= 2 * LONGEST else self.text[start : start + LONGEST] + self.text[end - LONGEST : end]

    def listed(self, which: int, token: str, mark: int) -> bool:
        """Whether the token before ``mark`` is in a list of abbreviations of the language there.

        The script chooses the languages that can be meant; of several, it is the one whose frequent words the surroundings
        (not before the last sentence end) have most of. Where these don't tell, an entry of any of them counts.
        """
        if token not in _KNOWN[which]:
            return False
        holders = [lang for lang, words in _LISTS[which].items() if token in words]
        for script in _SCRIPTS:
            if holders[0] in script:
                return len(holders) == len(script) or language_of(self.text[max(self.ends[-1] if self.ends else 0, mark - AROUND) : mark + AROUND], script) in (None, *holders)
        return True


def _quoted(line: str) -> list[tuple[int, int]]:
    """Spans (opening, closing mark) of quotations that both open and close in the line; none inside another."""
    spans, at, n = [], 0, len(line)
    missing: set[str] = set()
    for found in _QUOTE.finditer(line):
        if found.start() < at:
            continue
        at = found.start()
        mark, end = line[at], -1
        if mark in _PAIRS:
            ends = []
            for c in _PAIRS[mark]:
                if c not in missing:
                    p = line.find(c, at + 1)
                    if p > 0:
                        ends.append(p)
                    else:
                        missing.add(c)
            end = min(ends, default=-1)
        elif mark not in missing:
            before, after = line[at - 1] if at else " ", line[at + 1] if at + 1 < n else " "
            if not after.isspace() and not before.isalnum():
                end = at
                while True:
                    end = line.find('"', end + 1)
                    if end < 0 or not (line[end - 1].isalnum() and end + 1 < n and line[end + 1].isalnum()):
                        break
                if end < 0:
                    missing.add(mark)
        if end > 0:
            spans.append((at, end))
            at = end
        at += 1
    return spans


def _starts_sentence(line: str, at: int) -> bool:
    """Whether what stands at ``at`` can begin a sentence: a capital, a digit, an opening mark, or a letter without case."""
    while at < len(line) and (line[at] in _OPENING or line[at] in "*_-–—•"):
        if line[at] in "—–-":
            return False
        at += 1
        while at < len(line) and line[at].isspace():
            at += 1
    if at >= len(line):
        return True
    first = line[at]
    if first.islower():
        return line[at + 1 : at + 2].isupper()
    return first.isalnum() or not first.isascii()


def _abbreviated(line: _Line, mark: int, after: int) -> bool:
    """Whether the dot at ``mark`` belongs to an abbreviation, an initial or an ordinal, given what stands at ``after``."""
    start, whole = line.token(mark)
    token = whole
    if not line.listed(_MAYBE, token.lower().strip("([{*_"), mark):
        token = _GLUED.split(token)[-1]
    low = token.lower().strip("([{*_")
    if not low:
        return False
    nxt = line.text[after : after + 1]
    if low[-1].isdigit():
        return low.isdigit() and len(low) <= 2 and line.word_before(mark).lower() in BEFORE_ORDINAL and nxt.isalpha()
    if _THAI.match(low[-1]):
        return True
    if low == "st" and nxt.isupper():
        word = line.word_before(mark)
        return not (word and word[0].isupper() and not word.endswith("."))
    number = line.listed(_NUMBER, low, mark)
    if line.listed(_MAYBE, low, mark) and not (number and nxt.isdigit()):
        return False
    if line.listed(_NEVER, low, mark):
        follows = _RUN.match(line.text, after) if low in ORDINARY else None
        return not (follows and any(follows[0].lower() in words for words in _TELLING.values()))
    if number and (nxt.isdigit() or nxt in "#№"):
        return True
    letters = low.rpartition(".")[2]
    if len(letters) != 1 or not letters.isalpha():
        return False
    if "." in low or "-" in low:
        return False
    word = line.word_before(mark)
    before = word.lower()
    if before and before[-1] == "." and len(before.strip("([{.*_")) == 1:
        return not line.listed(_MAYBE, f"{before.strip('([{.*_')}.{low}", mark)
    if not token[-1].isupper():
        return not before.isdigit()
    if not before or not before[-1].isalnum() or word[0].isupper() or len(token) < len(whole):
        return True
    return before in BEFORE_INITIAL


def _continues_after_quote(line: str, opening: int, at: int) -> bool:
    """Whether a sentence goes on behind quoted speech that closed just before ``at`` without white space (scripts without spaces)."""
    rest = line[at : at + 24]
    if rest.startswith(ON_JA) and line[at - 1] in "」』":
        return True
    if line[at - 1] in "」』":
        return False
    if rest.startswith(("，", "、", ",")):
        return True
    while opening and line[opening - 1].isspace():
        opening -= 1
    if opening and line[opening - 1] in "：:":
        return rest.startswith(ON_ZH)
    clause = re.split("[。！？…，,：:“\"\\s]", rest, maxsplit=1)
    if clause[0].startswith(ON_ZH):
        return True
    follows = rest[len(clause[0]) : len(clause[0]) + 1]
    return 0 < len(clause[0]) <= 12 and clause[0].endswith(SAID_ZH) and follows not in ("：", ":")


def _ends(line: str) -> list[int]:
    """Positions in the line where a sentence ends, besides its own end."""
    quotes = _quoted(line)
    start = _PREFIX.match(line).end()
    opened, starts = {b for _, b in quotes}, {a for a, _ in quotes}
    begins = [a for a, _ in quotes]

    def quote_at(place: int) -> tuple[int, int] | None:
        at = bisect_right(begins, place) - 1
        return quotes[at] if at >= 0 and place < quotes[at][1] else None

    parts = None
    ends, n = [], len(line)
    for found in _MARK.finditer(line, start):
        first, at = found.span()
        marks = found[0]
        if quotes and (quote := quote_at(first)):
            behind = at
            while behind < quote[1] and line[behind] in _BEHIND:
                behind += 1
            if behind < quote[1]:
                continue
            at = quote[1] + 1
            while at < n and line[at] in _CLOSE and line[at] not in "“«„「『":
                at += 1
            if at < n and not line[at].isspace() and not _EMOJI.match(line, at):
                if line[at] in ",;:،-—–" or line[at].islower():
                    continue
                if _continues_after_quote(line, quote[0], at):
                    continue
                ends.append(at)
                continue
            spaced = _SPACES.match(line, at)
            after = spaced.end() if spaced else at
            emoji = _EMOJI.match(line, after)
            if not emoji and after < n and (not _starts_sentence(line, after) or line[after] in "—–-,;"):
                continue
        else:
            while at < n and line[at] in _CLOSE and at not in starts and (at in opened or line[at] not in "\"“«„‘「『([{（【"):
                at += 1
            nxt = line[at : at + 1]
            wide = any(c in _WIDE or c == "।" or c == "॥" for c in marks)
            soft = all(c in _SOFT for c in marks)
            spaced = _SPACES.match(line, at)
            after = spaced.end() if spaced else at
            emoji = _EMOJI.match(line, after)
            if wide:
                pass
            elif not spaced and nxt and not emoji:
                before = line[first - 1 : first]
                parts = parts or _Line(line, ends)
                begun, token = parts.token(first)
                if nxt in ",;:،)" or nxt.isdigit() or nxt.islower() or not (nxt.isalpha() or nxt in _OPENING):
                    continue
                if nxt.isascii() and nxt in "/=&#@\\_*'":
                    continue
                if len(token) <= 2 and line[at + 1 : at + 2] == ".":
                    continue
                if soft and (len(token) < 2 or not before.isalpha() or before.isupper() or (first - begun > LONGEST or "." in token) or "@" in token or parts.listed(_NEVER, token.lower(), first)):
                    continue
            elif soft and not emoji and after < n:
                if marks == ".":
                    parts = parts or _Line(line, ends)
                    if _abbreviated(parts, first, after):
                        continue
                if not _starts_sentence(line, after):
                    continue
            elif soft and emoji and marks == ".":
                parts = parts or _Line(line, ends)
                if _abbreviated(parts, first, n) and parts.listed(_NEVER, parts.token(first)[1].lower(), first):
                    continue
        while emoji:
            at = emoji.end()
            spaced = _SPACES.match(line, at)
            emoji = _EMOJI.match(line, spaced.end() if spaced else at)
        ends.append(at)
    if _THAI.search(line):
        done = set(ends)
        for gap in _SPACES.finditer(line, start):
            left, right = gap.start(), gap.end()
            if right >= n or left <= start or left in done or (quotes and quote_at(left)):
                continue
            emoji = _EMOJI.match(line, right)
            if emoji or line[right].isdigit():
                continue
            back = left
            while back > start and _is_emoji_end(line, back):
                back = _before_emoji(line, back)
            if back <= start or not _THAI.match(line[back - 1]) or line[back - 1].isdigit() or _THAI_SHORT.match(line, right):
                continue
            ends.append(left)
        ends.sort()
    return ends


_LAST_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Presentation}️‍\p{Emoji_Modifier}]")


def _is_emoji_end(line: str, at: int) -> bool:
    return at > 0 and not line[at - 1].isascii() and bool(_LAST_EMOJI.match(line[at - 1]))


def _before_emoji(line: str, at: int) -> int:
    while _is_emoji_end(line, at):
        at -= 1
    while at and line[at - 1].isspace():
        at -= 1
    return at


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence in code points, end exclusive, without white space at both ends."""
    spans: list[tuple[int, int]] = []
    for found in _LINE.finditer(text or ""):
        line, offset = found[0], found.start()
        if _HIDDEN.fullmatch(line):
            continue
        begin = 0
        for end in [*_ends(line), len(line)]:
            piece = line[begin:end]
            bare = piece.strip()
            if bare and not _HIDDEN.fullmatch(bare):
                lead = len(piece) - len(piece.lstrip())
                spans.append((offset + begin + lead, offset + begin + lead + len(bare)))
            begin = end
    return spans


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos, sentence_no (from 1) of every sentence of every document.

    A line break always ends a sentence; a line without end marks is one sentence, but for Thai, where a space ends one.
    Null, empty and blank texts have none; a repeated row gives its sentences again; a null doc_id is reported as null.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, first, last, number = [], [], [], []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                spans = split_sentences(text)
                ids.extend([doc_id] * len(spans))
                first.extend(a for a, _ in spans)
                last.extend(b for _, b in spans)
                number.extend(range(1, len(spans) + 1))
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start_pos": first, "end_pos": last, "sentence_no": number})

    return documents.select("doc_id", "text").mapInPandas(split, "doc_id long, start_pos long, end_pos long, sentence_no long")
