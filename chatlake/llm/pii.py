"""Personal data in free text: found by kind, and replaced by keyed surrogates of the same kind, script and format."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Container, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.lexicon import SHARED_WORDS, Words, fingerprint, with_known, word_set
from chatlake.operators.running import beside, ranged_running_sum

KINDS = ("email", "phone", "id_number", "address", "name")
COMMON_SHARE = 1e-4
"""A word that this share of the texts contains is an ordinary word; rarer ones, capitalised side by side, can be a name."""
NUMBERED = 1 << 40
"""Attempts from here on are numbered surrogates: what is above is a number that no other entity of the kind has."""

_DIGITS = {ord(c): str(i) for base in (0xFF10, 0x660, 0x6F0, 0x966) for i, c in enumerate(map(chr, range(base, base + 10)))} | {0xFF0B: "+", 0xFF20: "@", 0x2011: "-", 0xA0: " ", 0x202F: " "}

_AT = r"\s?[\[({<]\s?(?:at|arroba|собака|ät|arobase)\s?[\])}>]\s?"
_AT_WORD = r"\s(?:at|arroba|собака|arobase|שטרודל|כרוכית)\s"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punto|точка|punkt|point|ponto)\s?[\])}>]\s?|\s(?:dot|punto|точка|punkt|point|ponto|נקודה)\s)"
EMAIL = re.compile(
    rf"(?<![\w.+@-])\w[\w.+-]*(?:(?:@|\s@\s|{_AT})[^\W_][\w-]*(?:(?:{_DOT}|\.)[\w-]+)*(?:{_DOT}|\.)[^\W\d_]{{2,}}"
    rf"|{_AT_WORD}[^\W_][\w-]*(?:(?:{_DOT}|\.)[\w-]+)*{_DOT}[^\W\d_]{{2,}})",
    re.IGNORECASE,
)
_MAYBE_EMAIL = re.compile(rf"\w@\w|\s@\s|{_AT}|{_AT_WORD}\S+{_DOT}", re.IGNORECASE)
LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*", re.IGNORECASE)
HANDLE = re.compile(r"(?<![\w.])[@#][\w-]+")

_EXT = r"(?:,?\s?(?:ext|extn|x|extension|доб|Durchwahl|DW|poste|anexo|ramal|שלוחה)\.?:?\s?\d{1,6}(?!\d))?"
PHONE = re.compile(
    r"(?<![\w+#/.:-])(?:"
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+|00[ ]?)44[ ]?\(?0?\)?(?:\d{2}[ ]\d{4}[ ]\d{4}|\d{3}[ ]\d{3}[ ]\d{4}|\d{4}[ ]\d{6}|\d{4}[ ]\d{3}[ ]\d{3}|\d{10})"
    r"|(?:\+|00[ ]?)(?!1\d)\d{2,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,5}){2,4}"
    r"|\(0?\d{2,4}\)[ ]?\d{3,4}[ .-]?\d{4}"
    r"|(?:1[-. ])?\d{3}-\d{3}-\d{4}|(?:1\.)?\d{3}\.\d{3}\.\d{4}"
    r"|0\d{4}[ ]\d{3}[ ]\d{3}|0\d{4}[ ]\d{6}|0\d{2}[ ]\d{4}[ ]\d{4}|0\d{3}[ ]\d{3}[ ]\d{4}"
    r"|0\d(?:[ .]\d\d){4}|0\d{1,2}-\d{7}|05\d[- ]\d{3}[- ]?\d{4}"
    r"|[78][ -]?\(?\d{3}\)?[ -]\d{3}[ -]\d{2}[ -]\d{2}"
    rf"){_EXT}(?![\w]|[-/:]\d|\.\d)",
    re.IGNORECASE,
)

_ID_STRONG = re.compile(r"(?<![\w#-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|[A-Z]{1,2}\d{7}|\d{8}[A-HJ-NP-TV-Z]|[XYZ]\d{7}[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}-\d{3}-\d{3} \d{2})(?![\w-])", re.IGNORECASE)
_ID_CUED = re.compile(r"(?<![\w#.,:/+-])(?:\d{2} \d{2} \d{6}|\d{4} \d{6}|\d{9}|[A-Z]\d{8}|[A-Z]{2,3}\d{6,8}|\d{8,12}|[A-Z0-9]{9})(?![\w-]|[.,:/]\d)", re.IGNORECASE)
# Words that name a person's document or number, and words that name the number of a thing.
_ID_WORDS = re.compile(
    r"passport|passeport|pasaporte|passaporte|reisepass|паспорт|דרכון|جواز|social|\bssn\b|\bnino?\b|insurance|national id|identity|\bid\b|licen[cs]e|führerschein|permis|permiso de conducir|\bdni\b|\bnie\b|ausweis|снилс|удостоверени|водительск|תעודת זהות|ת\"ז|\bתז\b|רישיון|هوية|رخصة|\bcpf\b|cédula|carte d'identité|посвідчення",
    re.IGNORECASE,
)
_THING_WORDS = re.compile(r"order|ticket|invoice|receipt|serial|build|isbn|epoch|version|commande|pedido|incidencia|bestellung|rechnung|заявка|заказ|הזמנה|הקריאה|#|№", re.IGNORECASE)

_SMALL = r"(?!(?:of|on|the|in|to|at|for|us|and|was|were|until|a|an|is|our|my|your|with|by|from|as|that|this|new|or|if|so|it|we|i|you|he|she|they|than|but|only|more|days?|minutes?|hours?|people|calls?|chairs?|boxes|tokens?|messages|times?|percent|section)\s)"
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|ste\.?)\s\w{1,5}"
_NUM = r"\d{1,5}"
# Words for streets, per language.
_STREETS_EN = "street st avenue ave road rd lane ln drive dr crescent cres boulevard blvd court ct square sq way place pl terrace close gardens row hill grove mews parade walk quay alley gate"
_STREETS_ES = "calle c avenida avda av plaza pza paseo camino carretera ronda travesía pasaje rua travessa praça largo estrada alameda"
_STREETS_FR = "rue avenue impasse boulevard bd place chemin allée quai cours route passage square sentier villa"
_STREETS_RU = "улица улице улицу улицы ул проспект проспекте проспекта просп пр пр-т пер переулок переулке шоссе бульвар бульваре б-р площадь площади пл набережная набережной наб вулиця вулиці вул провулок"
_STREETS_HE = "רחוב רח שדרות שד סמטת דרך כיכר"
_STREETS_AR = "شارع طريق زقاق جادة"
_ENDS_DE = ("straße", "strasse", "str.", "gasse", "platz", "allee", "damm", "ufer", "weg")
_LAST_DE = "steg berg bach hof tor tal see markt feld buch hain hang wall graben eck winkel burg bühl kamp teich wiese garten moor holz wald brunnen anger rain".split()
_STREET = "(?:" + _STREETS_EN.replace(" ", "|") + ")"


def _keyed(words: str) -> frozenset[str]:
    return frozenset(words.split())


_I = re.IGNORECASE
_ADDRESSES = [
    (_keyed(_STREETS_EN), re.compile(rf"(?:(?<!\w){_UNIT},?\s)?(?<![\w.,:/+-]){_NUM}\s?[a-z]?\s(?:{_SMALL}[^\W\d_][\w'’-]*\s){{1,3}}{_STREET}\b\.?(?:,?\s{_UNIT}\b)?", _I)),
    (_keyed(_STREETS_ES), re.compile(rf"(?<!\w)(?:c/|(?:{_STREETS_ES.replace(' c ', ' ').replace(' ', '|')})\.?)\s?(?:[^\W\d_][\w'’-]*\.?\s){{1,5}}?(?:,\s?)?(?:n\.?º\s?)?{_NUM}(?:,\s?\d{{1,2}}\s?\.?\s?[ºª](?:\s?[a-z](?![\w]))?)?", _I)),
    (_keyed(_STREETS_FR), re.compile(rf"(?<![\w.,:/+-]){_NUM}(?:\s?(?:bis|ter|quater))?,?\s(?:{_STREETS_FR.replace(' ', '|')})\s(?:d[eu]s?\s|de\sla\s|de\sl['’]|l[ea]s?\s|d['’])*[^\W\d_][\w'’-]*", _I)),
    (_keyed(_STREETS_RU), re.compile(rf"(?<!\w)(?:{_STREETS_RU.replace(' ', '|')})\.?\s[^,\n\d]{{2,40}},?\s?(?:д\.|дом|буд\.)?\s?{_NUM}\s?[а-я]?(?![\w])(?:,?\s?(?:кв\.|квартира|оф\.)\s?\d+)?", _I)),
    (_keyed(_STREETS_HE + " " + " ".join("ב" + w for w in _STREETS_HE.split())), re.compile(rf"(?<!\w)ו?ב?(?:{_STREETS_HE.replace(' ', '|')})['׳]?\s[֐-׿][֐-׿'\"׳״ -]{{1,30}}?\s{_NUM}(?!\d)(?:,?\s?(?:דירה|כניסה)\s?\w+)?")),
    (_keyed(_STREETS_AR), re.compile(rf"(?<!\w)(?:{_STREETS_AR.replace(' ', '|')})\s[^\d\n,،.]{{2,30}}\s(?:رقم\s)?{_NUM}")),
]
_ADDRESS_DE = re.compile(
    rf"(?<!\w)[^\W\d_][\w-]*(?:{'|'.join(map(re.escape, _ENDS_DE))})\s{_NUM}\s?[a-z]?\b"
    rf"|(?<!\w)(?:am|an\sder|an\sden|auf\sdem|auf\sder|im|in\sder|zum|zur|unter\sden|hinter\sdem|alte[rn]?|neue[rn]?|großer?|kleiner?)\s(?:[^\W\d_][\w-]+\s){{0,2}}[\w-]*(?:{'|'.join(_LAST_DE)})\s{_NUM}\s?[a-z]?\b",
    _I,
)

_ADDRESS_CJK = re.compile(
    r"[^\W\d_在到是于去]{1,10}(?:路|街|大道|大街|胡同|巷|弄)\s?\d{1,5}\s?[号號](?:\s?\d{1,4}\s?(?:室|单元|楼|樓)){0,3}"
    r"|[^\W\d_はをがにで]{1,12}[町区市村]\s?\d{1,4}(?:(?:丁目|番地|番|号|[-−‐])\d{0,4}){1,4}"
)
_PHONE_CUED = re.compile(r"(?:call|phone|tel|telephone|mobile|cell|whatsapp|text|fax|ring|dial)\b[^\d\n]{0,12}(?P<number>\d{3} \d{3} \d{4})(?![\w-])", _I)

_PARTICLE = "de|del|della|la|las|los|van|von|der|den|di|da|do|dos|du|le|al|el|bin|ibn|ben|bar|ter|ten|zu|of"
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’׳‑-](?=[^\W\d_]))*")
# Words that can't be part of a name after a cue.
_NO_NAME = frozenset(
    """the a an and or but so if is are was were be been has have had do does did not no yes i you he she it we they me him her us them my your his its our their
    this that these those here there who what which when where why how to of in on at by for from with about into over after before as than then just now only also
    number telefon teléfono phone mail please thanks again today tomorrow later someone anyone everybody everyone nobody me
    und oder aber der die das ein eine ist sind war ich du er sie es wir ihr mein dein nicht mit bei für auf uns im in bin neu dir mir ihm ihnen
    y o pero el la los las un una es son soy me te se mi tu su no con por para en que casa nosotros soy está
    et ou mais le les un une est suis je tu il elle nous vous mon ton son ne pas avec chez pour en que dans
    и или но а я ты он она оно мы вы они мой твой наш ваш не с у в на по к о для что как это только нас вас него неё
    את אני אתה הוא היא אנחנו הם לא עם של על או גם זה מה
    hall crew group team committee building bakery street road lane avenue house room school office company inc ltd gmbh""".split()
)
# Short words after which a person can be named, per language.
_BEFORE_PERSON = frozenset(
    """for with by from to of and is was are know knows call called ask tell told met meet see saw contact thank thanks hi hello hey dear holder name named or
    bei mit von für und ist an kennt frau herr con de por para y es a conoce avec chez pour par et est à connaît com do da é
    у с от к для и на это של את עם אצל עבור על זה من مع إلى عند""".split()
)
_GREETINGS = frozenset("hi hello hey dear hallo hola salut bonjour olá oi привет здравствуйте привіт היי שלום".split())
# Words behind a capitalised pair that make it a place, a firm or a thing.
_NO_PERSON = frozenset(
    f"""{_STREETS_EN} {_STREETS_ES} {_STREETS_FR} bakery hall school building house room office company inc ltd gmbh llc corp group team committee club crew band cafe café bar shop store market museum
    library park bridge station hotel university college institute hospital church centre center garden beach river lake island north south east west city town village county street""".split()
)
# Phrases that introduce a person by full name, per language: introductions, signatures, addressees, titles.
_CUES = re.compile(
    r"(?<!\w)(?:my name is|(?:is|was|am|are) (?:called|named)|(?:full |real )?name:|signed:?|contact:|ask for|addressed to|(?:parcel|package|letter|mail|message) (?:for|to)|on behalf of|in the name of|care of|c/o|attn:?|(?:regards|sincerely|cheers|yours),?|(?:mr|mrs|ms|dr|prof)\.?|"
    r"ich heiße|mein name ist|(?:er|sie) heißt|im namen von|gezeichnet:?|(?:paket|brief|post|nachricht) (?:für|an)|(?:herr|herrn|frau)|me llamo|mi nombre es|se llama|a nombre de|firmado:?|(?:paquete|carta|mensaje) (?:de|para)|(?:sr|sra|don|doña)\.?|je m['’]appelle|mon nom est|s['’]appelle|au nom de|signé:?|(?:colis|lettre|message) (?:de|pour)|(?:m|mme|mlle)\.|monsieur|madame|"
    r"me chamo|(?:meu|o) nome é|chama-se|em nome de|меня зовут|(?:моё|мое) имя|(?:его|её|ее) зовут|на имя|от имени|(?:посылка|письмо) (?:для|от)|(?:спросите|позвоните)(?: у)?|мене звати|(?:його|її) звати|на ім['’]я|שמי|קוראים לי|על שם|בשם|(?:ה?חבילה|ה?מכתב) (?:של|עבור)|(?:תשאלו|שאלו|תתקשרו) (?:את|אל)|اسمي|اسمه|اسمها|باسم)\s+[\"“«„']?",
    re.IGNORECASE,
)
_SIGNATURE = re.compile(r"(?:regards|greetings|wishes|sincerely|grüße|saludos|cordialement|уважением)[^\n]*\n+\s*", re.IGNORECASE)
# A word of each of these phrases, so texts without any are passed over quickly.
_CUE_WORDS = frozenset(
    """name called named signed contact ask addressed parcel package letter mail message behalf care c attn regards sincerely cheers yours mr mrs ms dr prof greetings wishes
    heiße heißt mein namen gezeichnet paket brief post nachricht herr herrn frau grüße llamo llama nombre firmado paquete carta mensaje sr sra don doña saludos
    m'appelle m’appelle s'appelle s’appelle nom signé colis lettre monsieur madame m mme mlle cordialement chamo nome chama-se
    зовут имя имени посылка письмо спросите позвоните уважением звати ім'я ім’я שמי קוראים שם בשם חבילה החבילה מכתב המכתב תשאלו שאלו תתקשרו اسمي اسمه اسمها باسم""".split()
)

_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґё", ["", "b", "b", "g", "d", "", "g", "z", "", "", "k", "l", "m", "n", "", "p", "r", "s", "t", "", "p", "", "z", "z", "s", "s", "", "", "", "", "", "", "", "", "", "g", ""], strict=True))
_HEBREW = dict(zip("אבגדהוזחטיכךלמםנןסעפףצץקרשת", ["", "b", "g", "d", "", "", "z", "", "t", "", "k", "k", "l", "m", "m", "n", "n", "s", "", "p", "p", "z", "z", "k", "r", "s", "t"], strict=True))
_LATIN = dict(zip("abcdefghijklmnopqrstuvwxyzßçñ", ["", "b", "k", "d", "", "p", "g", "", "", "", "k", "l", "m", "n", "", "p", "k", "r", "s", "t", "", "b", "b", "ks", "", "z", "s", "k", "n"], strict=True))
_ENDINGS = re.compile("(?:ами|ями|ого|ому|ому|ыми|ой|ою|ом|ем|ым|ую|ая|а|я|у|ю|е|и|ы|і)$")


def skeleton(word: str) -> str:
    """The consonants of a name, alike for its Latin, Cyrillic and Hebrew spellings."""
    word = word.lower()
    if "֐" <= word[:1] <= "׿":
        word = word.replace("וו", "ב")
        if word[0] == "ו":
            word = "ב" + word[1:]
        raw = "".join(_HEBREW.get(c, "") for c in word)
    elif "Ѐ" <= word[:1] <= "ӿ":
        raw = "".join(_CYRILLIC.get(c, "") for c in word.replace("кс", "кс").replace("дж", "ж"))
    else:
        raw = "".join(_LATIN.get(c, "") for c in word.replace("ph", "f").replace("qu", "k").replace("ck", "k").replace("sch", "s").replace("sh", "s").replace("ch", "k"))
    return re.sub(r"(.)\1+", r"\1", raw)


def form(kind: str, word: str) -> int:
    """The print of a word as a given (g) or family (f) name, or of its skeleton (sg, sf)."""
    return fingerprint(f"{kind}:{word}")


def name_forms(people: DataFrame) -> DataFrame:
    """word: the forms of known given and family names, whole, in parts and as skeletons; null and empty names have none."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: set[str] = set()
            for kind, column in (("g", batch.first_name), ("f", batch.last_name)):
                for name in set(column.dropna()):
                    for word in {name.strip().lower(), *name.lower().split()}:
                        if len(word) > 1:
                            found |= {f"{kind}:{word.replace('’', chr(39))}", f"s{kind}:{skeleton(word)}"}
            yield pd.DataFrame({"word": sorted(found)})

    return people.select("first_name", "last_name").distinct().mapInPandas(forms, "word string")


def common_words(texts: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """word: a form (c) of each word that at least ``share`` of the rows (column text), and two, contain in any case, and one (l) if so many have it in small letters.

    Rows with n words on average have at most 2 n / ``share`` of them, however large the table is.
    """
    words = F.array_distinct(F.split("text", r"[^\p{L}]+"))
    counts = texts.where("text is not null").select(F.explode(words).alias("w")).where("w <> ''").groupBy(F.lower("w").alias("low")).agg(F.count("*").alias("c"), F.count_if(F.col("w") == F.lower("w")).alias("l"))
    total = texts.agg(F.greatest(F.lit(2), F.ceil(F.lit(share) * F.count("text"))).alias("least"))
    kinds = F.array_compact(F.array(F.lit("c:"), F.when(F.col("l") >= F.col("least"), "l:")))
    return beside(counts, total).where(F.col("c") >= F.col("least")).select(F.explode(kinds).alias("kind"), "low").select(F.concat("kind", "low").alias("word"))


def known_names(people: DataFrame, texts: DataFrame | None = None, limit: int = SHARED_WORDS) -> Words | DataFrame:
    """The forms of known names and of the common words of ``texts``, in memory or, if there are more than ``limit``, as a table."""
    words = name_forms(people)
    return word_set(words if texts is None else words.unionByName(common_words(texts)), limit=limit)


def bones(word: str) -> set[str]:
    """The skeletons of the forms that a word in Cyrillic or Hebrew letters may stand for, without ending or prefix."""
    if word[0].isascii() or len(word) < 3:
        return set()
    low = word.lower().replace("’", "'")
    forms = {low, _ENDINGS.sub("", low)} if "Ѐ" <= low[0] <= "ӿ" else {low, low[1:]} if "֐" <= low[0] <= "׿" else set()
    return {skeleton(f) for f in forms if f} - {""}


def forms_of(text: str) -> set[int]:
    """The prints of every form of a name that a word of the text can be."""
    plain = text.translate(_DIGITS) if not text.isascii() else text
    found: set[int] = {form(kind, word) for word in set(_LETTERS.findall(plain.lower())) for kind in "cl"}
    for word in set(_TOKEN.findall(plain)):
        found |= {form(kind, word.lower().replace("’", "'")) for kind in "gf"} | {form(f"s{kind}", b) for kind in "gf" for b in bones(word)}
    return found


_DIGIT = re.compile(r"\d")
_SIX = re.compile(r"\d(?:\D{0,3}\d){5}")
_HYPHENED = re.compile(r"[^\W\d_](?:[^\W\d_]|-(?=[^\W\d_]))*")
_LETTERS = re.compile(r"[^\W\d_]+")


class Finder:
    """Finds pieces in one text at a time; ``names`` has the prints of the forms of known names."""

    def __init__(self, names: Container[int]) -> None:
        self.names = names
        self.seen: dict[str, tuple[str, int, bool]] = {}

    def _about(self, word: str) -> tuple[str, int, bool]:
        """Of a word: g and f if it is known as given or family name; 2 if no part of it is common in the texts, 1 if none is in small letters, else 0; whether a cue has it."""
        found = self.seen.get(word)
        if found is None:
            low = word.lower()
            parts = _LETTERS.findall(low)
            parts = parts[1:] if len(parts) > 1 and parts[0] in ("al", "el") else parts
            if low in _NO_NAME or len(word) < 3 or any(form("l", part) in self.names for part in parts):
                rare = 0
            else:
                rare = 1 if any(form("c", part) in self.names for part in parts) else 2
            found = self._class(word), rare, low in _CUE_WORDS
            if len(self.seen) < 200_000:
                self.seen[word] = found
        return found

    def _class(self, word: str) -> str:
        found = "".join(kind for kind in "gf" if form(kind, word.lower().replace("’", "'")) in self.names)
        return found or "".join(kind for kind in "gf" if any(len(b) >= (2 if kind == "g" else 3) and form(f"s{kind}", b) in self.names for b in bones(word)))

    def _name_at(self, text: str, tokens: list[re.Match], i: int, cued: bool) -> int:
        """How many tokens from the i-th are a full name; 0 if none."""

        def gap(k: int) -> str:
            return text[tokens[k].end() : tokens[k + 1].start()] if k + 1 < len(tokens) else "\n"

        def initial(k: int) -> bool:
            return len(tokens[k][0]) == 1 and text[tokens[k].end() : tokens[k].end() + 1] == "." and (tokens[k][0].isupper() or cued)

        def capital(word: str) -> bool:
            return word[0].isupper() or (word[:3].lower() in ("al-", "el-") and word[3].isupper())

        def shaped(k: int) -> bool:
            word = tokens[k][0]
            return len(word) > 1 and word.lower() not in _NO_NAME

        first = tokens[i][0]
        kinds = self._about(first)[0]
        strange = first[0] > "ʯ"
        spaced, comma = (" ", "  "), (", ", ",")
        k = i
        if initial(i):
            while gap(k) in (". ", ".") and k + 1 < len(tokens) and initial(k + 1):
                k += 1
            if gap(k) in (". ", ".") and k + 1 < len(tokens):
                j = k + 1
                while j + 1 < len(tokens) and re.fullmatch(_PARTICLE, tokens[j][0], re.IGNORECASE) and gap(j) == " ":
                    j += 1
                last = tokens[j][0]
                if "f" in self._about(last)[0] or (shaped(j) and len(last) > 2 and cued and (capital(last) or not tokens[i][0].isupper())):
                    return j + 1 - i
            return 0
        if not (kinds or cued) or not shaped(i):
            if not (capital(first) and shaped(i)):
                return 0
        while gap(k) == " " and k + 1 < len(tokens) and initial(k + 1) and text[tokens[k + 1].end() :][:2] == ". ":
            k += 1
        after_initial = k > i
        joint = gap(k) if not after_initial else text[tokens[k].end() + 1 : tokens[k + 1].start()] if k + 1 < len(tokens) else "\n"
        if k + 1 >= len(tokens):
            return 0
        j = k + 1
        if joint in spaced:
            while j + 1 < len(tokens) and re.fullmatch(_PARTICLE, tokens[j][0], re.IGNORECASE) and gap(j) == " ":
                j += 1
            last = tokens[j][0]
            theirs = self._about(last)[0]
            particles = j > k + 1
            if ("g" in kinds and "f" in theirs) or ("f" in kinds and "g" in theirs and not after_initial):
                return j + 1 - i
            if "f" in kinds and j == k + 1 and initial(j):
                return j + 1 - i
            if "֐" <= first[0] <= "׿" and "f" in theirs and not kinds and shaped(i) and len(first) > 2 and j == k + 1:
                return j + 1 - i
            if not shaped(j) or len(last) < 2:
                return 0
            mixed = not (first.isupper() or last.isupper())
            if cued and (not strange or first[0].isupper() == last[0].isupper()):
                return j + 1 - i if (not strange or first[0].isupper() or kinds or theirs) else 0
            if mixed and not strange and first[0].isupper() and last[0].isupper() and ("g" in kinds or ("f" in theirs and i and text[: tokens[i].start()].rstrip()[-1:].islower()) or (particles and "g" in kinds)):
                return j + 1 - i
            return 0
        if joint in comma and not after_initial:
            last = tokens[j][0]
            theirs = self._about(last)[0]
            extra = 1 if j + 1 < len(tokens) and gap(j) == " " and initial(j + 1) else 0
            if "f" in kinds and "g" in theirs:
                return j + 1 + extra - i
            if "f" in kinds and initial(j):
                return j + 1 - i
            if cued and not strange and capital(first) and last[0].isupper() and shaped(i) and shaped(j) and "g" not in kinds:
                return j + 1 + extra - i
        return 0

    def _unknown_at(self, text: str, tokens: list[re.Match], i: int) -> int:
        """How many tokens from the i-th are a full name told by its shape: rare words side by side, capitalised, or after a word that a person follows."""

        def between(k: int) -> str:
            return text[tokens[k].end() : tokens[k + 1].start()] if k + 1 < len(tokens) else "\n"

        def initial(k: int) -> bool:
            return len(tokens[k][0]) == 1 and tokens[k][0].isupper() and text[tokens[k].end() : tokens[k].end() + 1] == "."

        first = tokens[i][0]
        first_rare = 0 if initial(i) else self._about(first)[1]
        if not initial(i) and not first_rare:
            return 0
        before, apart = tokens[i - 1][0].lower() if i else "", text[tokens[i - 1].end() : tokens[i].start()].strip(" \"“«„'") if i else "."
        led = (apart == "" and before in _BEFORE_PERSON) or (apart == "," and before in _GREETINGS)
        j = i
        while j + 1 < len(tokens) and initial(j + 1) and between(j) in ((". ", ".") if initial(j) else (" ",)):
            j += 1
        joint = between(j)
        if initial(j):
            joint = joint.removeprefix(".")
        if j + 1 >= len(tokens) or joint not in (" ", ", ") or (joint == ", " and j > i):
            return 0
        listed = joint == ", " and not led
        j += 1
        while joint == " " and j + 1 < len(tokens) and re.fullmatch(_PARTICLE, tokens[j][0], re.IGNORECASE) and between(j) == " ":
            j += 1
        last = tokens[j][0]
        last_rare = self._about(last)[1]
        if not last_rare or max(first_rare, last_rare) < 2 or (listed and min(first_rare, last_rare) < 2):
            return 0
        if between(j) == " " and (tokens[j + 1][0].lower() in _NO_PERSON or (tokens[j + 1][0][0].isupper() and not tokens[j + 1][0].isupper() and self._about(tokens[j + 1][0])[1] == 2)):
            return 0
        if text[tokens[j].end() : tokens[j].end() + 2].strip(" ")[:1].isdigit():
            return 0
        cased = first[0] != first[0].swapcase()
        upper = first[0].isupper() and (last[3:] if last[:3].lower() in ("al-", "el-") else last)[:1].isupper()
        shouted = first.isupper() and last.isupper()
        if (upper and not shouted) or (shouted and any(map(str.islower, text))) or (led and (shouted or not cased or (first.islower() and last.islower()))):
            return j + 1 - i
        return 0

    def _names(self, text: str, low: str) -> list[tuple[int, int]]:
        words = _TOKEN.findall(text)
        if len(words) < 2:
            return []
        seen = self.seen
        about = [found if (found := seen.get(word)) is not None else self._about(word) for word in words]
        near: set[int] = set()
        far: set[int] = set()
        told = False
        for at, (kinds, rare, cue) in enumerate(about):
            if kinds:
                near.update(range(at - 3, at + 1))
            if rare == 2:
                far.update(range(at - 3, at + 1))
            told = told or cue
        if not (told or near or far):
            return []
        cues: dict[int, bool] = {}
        if told:
            cues = {m.end(): "signed" in m[0].lower() for m in _CUES.finditer(text)} | {m.end(): False for m in _SIGNATURE.finditer(text)}
            if not (cues or near or far):
                return []
        tokens = list(_TOKEN.finditer(text))
        found, i = [], 0
        while i < len(tokens):
            cued = bool(cues) and tokens[i].start() in cues
            count = self._unknown_at(text, tokens, i) if i in far and not cued else 0
            if not count and (cued or i in near):
                count = self._name_at(text, tokens, i, cued)
            if count:
                start, end = tokens[i].start(), tokens[i + count - 1].end()
                found.append((start, end))
                if cued and cues[start] and (joined := re.match(r"\s(?:and|und|et|y|и|e)\s", text[end : end + 8])):
                    cues[end + joined.end()] = True
            i += count or 1
        return found

    def pieces(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the pieces, in reading order, none overlapping."""
        if not text:
            return []
        digits = _DIGIT.search(text)
        plain = text.translate(_DIGITS) if (digits or "＠" in text) and not text.isascii() else text
        low = plain.lower()
        found: list[tuple[int, int, str]] = []

        def take(spans: Iterable[tuple[int, int]], kind: str | None) -> None:
            nonlocal plain
            for a, b in spans:
                if kind:
                    found.append((a, b, kind))
                plain = plain[:a] + "\x00" * (b - a) + plain[b:]

        if any(mark in plain for mark in "@[({<") or any(dot in low for dot in (" dot ", " punto ", " точка ", " punkt ", " point ", " ponto ", " נקודה ")):
            if _MAYBE_EMAIL.search(plain):
                take([m.span() for m in EMAIL.finditer(plain)], "email")
        if "://" in plain or "www." in plain:
            take([m.span() for m in LINK.finditer(plain)], None)
        if "@" in plain or "#" in plain:
            take([m.span() for m in HANDLE.finditer(plain)], None)
        if digits:
            words = set(_HYPHENED.findall(low))
            for keys, pattern in _ADDRESSES:
                if not keys.isdisjoint(words):
                    take([m.span() for m in pattern.finditer(plain)], "address")
            if any(end in low for end in _ENDS_DE) or any(end in low for end in _LAST_DE):
                take([m.span() for m in _ADDRESS_DE.finditer(plain)], "address")
            if not low.isascii() and _ADDRESS_CJK.search(plain):
                take([m.span() for m in _ADDRESS_CJK.finditer(plain)], "address")
            if _SIX.search(plain):
                things = lambda m: _THING_WORDS.search(plain, max(0, m.start() - 14), m.start())
                if _ID_WORDS.search(plain):
                    near = lambda m: _ID_WORDS.search(plain, max(0, m.start() - 60), m.start()) or _ID_WORDS.search(plain, m.end(), m.end() + 30)
                    cued = [m for m in _ID_CUED.finditer(plain) if sum(map(str.isdigit, m[0])) > 5]
                    take([m.span() for m in cued if near(m) and not things(m)], "id_number")
                take([m.span() for m in _ID_STRONG.finditer(plain) if not things(m)], "id_number")
                take([m.span() for m in PHONE.finditer(plain)], "phone")
                take([m.span("number") for m in _PHONE_CUED.finditer(plain)], "phone")
        take(self._names(plain, low), "name")
        return sorted(found)


def personal_data(texts: DataFrame, names: Words | DataFrame) -> DataFrame:
    """Pieces in ``texts`` (field, record_key, text): field, record_key, kind, nth, start, end, piece; nth counts per field, record and kind.

    Null and empty texts have none. Equal rows give equal pieces; a null record_key stays null. ``names`` as ``known_names``
    gives them: a set sent to the tasks, or a table that is joined with the words of the texts.
    """
    joined = isinstance(names, DataFrame)
    shared = texts.sparkSession.sparkContext.broadcast(None if joined else names)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = None if joined else Finder(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            known = batch.known if joined else [None] * len(batch)
            for field, key, text, marks in zip(batch.field, batch.record_key, batch.text, known, strict=True):
                count = dict.fromkeys(KINDS, 0)
                for start, end, kind in (Finder(frozenset(() if marks is None else map(int, marks))) if joined else finder).pieces(text):
                    count[kind] += 1
                    rows.append((field, key, kind, count[kind], start, end, text[start:end]))
            yield pd.DataFrame(rows, columns=["field", "record_key", "kind", "nth", "start", "end", "piece"])

    rows = texts.where("text is not null").select("field", "record_key", "text")
    if joined:
        rows = with_known(rows, "text", forms_of, names)
    return rows.mapInPandas(find, "field string, record_key string, kind string, nth long, start long, end long, piece string")


# Syllables, street words and mail domains of the surrogates, per script.
_SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta te to va vi".split(), "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то ва ви".split(), "hebrew": "בא ברו גל דו דן הל זר חן טל יו כר לב מר נר סל עד פל צר קו רם שן תם".split(), "arabic": "با دا را سا نا ما لا كا ها جا".split()}
_DOMAIN = "example.org"


def script_of(text: str) -> str:
    for c in text:
        if c.isalpha():
            return "hebrew" if "֐" <= c <= "׿" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "arabic" if "؀" <= c <= "ۿ" else "latin"
    return "latin"


def canonical(kind: str, piece: str) -> str:
    """What makes two pieces the same entity: digits of numbers, letters of mail addresses, the words of names in any order and case.

    Different spellings of a name are different names; only the endings of Cyrillic cases are left out. Spellings in other
    scripts are brought together by ``surrogates``, which sees all names.
    """
    piece = piece.translate(_DIGITS)
    if kind == "phone":
        return re.sub(r"\D", "", re.split(r"(?i)ext|x|доб", piece)[0]).removeprefix("00")
    if kind == "id_number":
        return re.sub(r"[^0-9A-Z]", "", piece.upper())
    if kind == "email":
        spelled = re.sub(_DOT, ".", re.sub(f"{_AT}|{_AT_WORD}", "@", piece, flags=re.I), flags=re.I)
        return re.sub(r"\s", "", spelled).lower()
    if kind == "name":
        words = (w.lower().replace("’", "'") for w in _TOKEN.findall(piece) if not re.fullmatch(_PARTICLE, w, re.IGNORECASE))
        return " ".join(sorted(_ENDINGS.sub("", w) or w if "Ѐ" <= w[0] <= "ӿ" and len(w) > 3 else w for w in words))
    return re.sub(r"[^\w]+", " ", piece.lower()).strip()


def likeness(kind: str, piece: str) -> str | None:
    """The skeletons of the words of a name, alike in all scripts; null for other kinds and names with an initial."""
    words = [w for w in _TOKEN.findall(piece) if not re.fullmatch(_PARTICLE, w, re.IGNORECASE)]
    if kind != "name" or any(len(w) < 2 for w in words):
        return None
    return " ".join(sorted(skeleton(_ENDINGS.sub("", w) if "Ѐ" <= w[0] <= "ӿ" else w) or w.lower() for w in words))


class _Stream:
    """Keyed choices: the same key, entity and attempt always give the same ones."""

    def __init__(self, key: str, *parts: object) -> None:
        self.seed = hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), key=key.encode()[:64]).digest()
        self.state, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.state += 1
            self.left += hashlib.blake2b(self.seed + self.state.to_bytes(4, "big")).digest()
        word, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(word, "big") % n


def _word(stream: _Stream, script: str, like: str) -> str:
    pool = _SYLLABLES[script]
    word = "".join(pool[stream.below(len(pool))] for _ in range(3))
    if script in ("latin", "cyrillic"):
        soft = like.lower()[-1:] in ("a", "а", "я")
        word += ("на" if script == "cyrillic" else "na") if soft else ("р" if script == "cyrillic" else "r")
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def _country_digits(phone: str) -> int:
    """How many leading digits of a phone number name its country or the way out of it."""
    bare = re.sub(r"[^\d+]", "", phone.translate(_DIGITS))
    if bare.startswith("+"):
        return 1 if bare[1:2] in ("1", "7") else 2
    if bare.startswith("00"):
        return 3 if bare[2:3] in ("1", "7") else 4
    return 1 if bare.startswith("0") or (len(bare) == 11 and bare[0] in "178") else 0


def surrogate(key: str, kind: str, entity: str, piece: str, attempt: int = 0) -> str:
    """A replacement of the same kind: numbers keep length and separators, names keep script, case, order, initials and the ending that marks gender.

    Attempts from NUMBERED on give the surrogate of attempt 0 with a number added, which no surrogate of an earlier attempt ends with.
    """
    if attempt >= NUMBERED:
        plain, number = surrogate(key, kind, entity, piece), attempt - NUMBERED
        return plain.replace("@", f"+{number}@") if kind == "email" else f"{plain} #{number}"
    stream = _Stream(key, kind, entity, attempt)
    if kind == "email":
        return f"{_word(stream, 'latin', 'x')}.{_word(stream, 'latin', 'x')}{stream.below(1000)}@{_DOMAIN}"
    if kind in ("phone", "id_number"):
        body, tail = (re.split(r"(?i)(\s*(?:ext|x|доб).*)", piece, maxsplit=1) + [""])[:2] if kind == "phone" else (piece, "")
        keep = _country_digits(body) if kind == "phone" else 0
        seen, out = 0, []
        for c in body:
            if c.isdigit():
                seen += 1
                out.append(c if seen <= keep else str(stream.below(10)))
            elif kind == "id_number" and c.isalpha():
                out.append(chr(65 + stream.below(26)) if c.isupper() else chr(97 + stream.below(26)))
            else:
                out.append(c)
        return "".join(out) + re.sub(r"\d", lambda _: str(stream.below(10)), tail)
    if kind == "address":
        return re.sub(r"\d+|[^\W\d_]{4,}", lambda m: str(1 + stream.below(10 ** len(m[0]) - 1)) if m[0].isdigit() else m[0] if re.fullmatch(rf"(?i){_STREET}|flat|unit|calle|avenida|rue|avenue|impasse|улица|проспект|рחוב|רחוב|ברחוב|דירה|בסמטת|בשדרות", m[0]) else _word(stream, script_of(m[0]), m[0]), piece)
    words = sorted({(skeleton(w) or w.lower()): w for w in _TOKEN.findall(piece) if len(w) > 1 and not re.fullmatch(_PARTICLE, w, re.IGNORECASE)}.items())
    new = {bone: _Stream(key, "name", entity, attempt, bone) for bone, _ in words}

    def renamed(m: re.Match) -> str:
        if re.fullmatch(_PARTICLE, m[0], re.IGNORECASE):
            return m[0]
        if len(m[0]) == 1:
            return chr(65 + _Stream(key, "initial", entity, attempt).below(26)) if m[0].isascii() else m[0]
        return _word(new[skeleton(m[0]) or m[0].lower()], script_of(m[0]), m[0])

    return _TOKEN.sub(renamed, piece)


def surrogates(pieces: DataFrame, key: str, rounds: int = 4) -> DataFrame:
    """Of each spelling its entity, and the attempt whose surrogates no other entity of the kind and no real piece has: kind, piece, entity, attempt.

    A name in another script is the entity of the one Latin name with its skeleton; where several have it, it stays a name of
    its own. Colliding entities, all but the smallest of each collision, and those whose surrogate is a real piece move on to
    the next attempt, up to ``rounds`` times; what still collides then, as in a space with fewer values than entities, gets its
    own number added (NUMBERED). Works on distinct spellings only, with map-side pre-aggregation.
    """
    from chatlake.session import settle

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(zip(batch.kind, batch.piece, strict=True))
            yield batch.assign(own=[canonical(k, p) for k, p in pairs], bones=[likeness(k, p) for k, p in pairs], latin=[script_of(p) == "latin" for _, p in pairs])

    spelled = settle(pieces.select("kind", "piece").distinct().mapInPandas(named, "kind string, piece string, own string, bones string, latin boolean"))
    one = spelled.where("latin and bones is not null").groupBy("kind", "bones").agg(F.min("own").alias("entity"), F.max("own").alias("last")).where("entity = last").drop("last")
    foreign = spelled.where("not latin and bones is not null").join(one, ["kind", "bones"]).select("kind", "piece", "entity")
    spellings = settle(spelled.join(foreign, ["kind", "piece"], "left").select("kind", "piece", F.coalesce("entity", "own").alias("entity"), "own"))
    real = spellings.select("kind", F.col("own").alias("fake"), F.lit(True).alias("real")).distinct()

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(fake=[canonical(k, surrogate(key, k, e, p, a)) for k, e, p, a in zip(batch.kind, batch.entity, batch.piece, batch.attempt, strict=True)])

    current = spellings.select("kind", "piece", "entity").withColumn("attempt", F.lit(0).cast("long"))
    for done in range(rounds + 1):
        made = settle(current.mapInPandas(tried, "kind string, piece string, entity string, attempt long, fake string"))
        clash = made.groupBy("kind", "fake").agg(F.min("entity").alias("owner"), F.max("entity").alias("last")).where("owner <> last")
        taken = made.join(real, ["kind", "fake"]).select("kind", "entity")
        moving = settle(made.join(clash, ["kind", "fake"]).where("entity <> owner").select("kind", "entity").unionByName(taken).distinct())
        if moving.isEmpty():
            break
        if done < rounds:
            moved = moving.withColumn("next", F.lit(1))
        else:
            moved = ranged_running_sum(moving, [], ["kind", "entity"], {"before": F.lit(1)}).select("kind", "entity", (NUMBERED + 1 + F.col("before")).alias("next"))
        current = made.join(moved, ["kind", "entity"], "left").select("kind", "piece", "entity", F.when(F.col("next") < NUMBERED, F.col("attempt") + F.col("next")).otherwise(F.coalesce("next", "attempt")).alias("attempt"))
        made = current
    return made.select("kind", "piece", "entity", "attempt")


def redacted(texts: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """field, record_key, text with each piece replaced by a typed placeholder that holds its surrogate: ``[NAME Debona Satero]``.

    Only texts with pieces are rewritten; the others come out as they are, null texts as null. Rows are told apart by
    (field, record_key); of several rows with one key each is rewritten by itself.
    """
    from chatlake.session import settle

    pieces = settle(pieces.select("field", "record_key", "kind", "start", "end", "piece").distinct())
    chosen = pieces.join(surrogates(pieces, key), ["kind", "piece"])
    edits = chosen.groupBy("field", "record_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "entity", "piece", "attempt"))).alias("edits"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, edits_of in zip(batch.text, batch.edits, strict=True):
                if text is None or edits_of is None:
                    out.append(text)
                    continue
                parts, at = [], 0
                for edit in edits_of:
                    if edit["start"] < at or text[edit["start"] : edit["end"]] != edit["piece"]:
                        continue
                    parts += [text[at : edit["start"]], f"[{edit['kind'].upper()} {surrogate(key, edit['kind'], edit['entity'], edit['piece'], edit['attempt'])}]"]
                    at = edit["end"]
                out.append("".join(parts) + text[at:])
            yield pd.DataFrame({"field": batch.field, "record_key": batch.record_key, "text": out})

    return texts.select("field", "record_key", "text").join(edits, ["field", "record_key"], "left").mapInPandas(rewrite, "field string, record_key string, text string")
