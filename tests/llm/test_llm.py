"""The language-model operators on small cases, against brute force, round trips or known answers."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import conversations as C
from chatlake.llm import language as L
from chatlake.llm import neighbours as N
from chatlake.llm import pii as P
from chatlake.llm.conversations import conversations
from chatlake.llm.leakage import TestSuffixes, leaked_passages, without_leaks, words_of
from chatlake.llm.lexicon import Words, fingerprint, word_set
from chatlake.llm.mixing import mixed, share_report, with_tokens
from chatlake.llm.sentences import sentences, split_sentences

# ---- conversations


def expected_turns(rows):
    by = {r["id"]: r for r in rows if r["id"] is not None}
    out = []
    for root in by.values():
        if root.get("reply_to_message_id") is not None:
            continue
        members, todo = [], [root]
        while todo:
            at = todo.pop()
            members.append(at)
            todo += [r for r in by.values() if r.get("reply_to_message_id") == at["id"]]
        shown = [m for m in members if re.search(r"\w", m.get("text_plain") or "")]
        late = any((m.get("date_unixtime") or 0) < by[m["reply_to_message_id"]]["date_unixtime"] for m in members if m is not root)
        bad = late or any(not m.get("date_unixtime") or not m.get("from_id") for m in members)
        if len(members) < 2 or bad or root not in shown or all(m["from_id"] == root["from_id"] for m in shown):
            continue
        for n, m in enumerate(sorted(shown, key=lambda m: (m["date_unixtime"], m["id"])), 1):
            out.append((root["id"], n, m["id"], "opener" if m["from_id"] == root["from_id"] else "answerer"))
    return sorted(out)


@pytest.mark.parametrize(("local", "queue"), [(100_000, 500_000), (-1, 20), (100_000, 20)])
def test_conversations_match_brute_force(chat, local, queue):
    rng = random.Random(4)
    rows = []
    for n in range(1, 400):
        rows.append({"id": n, "from_id": rng.choice(["a", "b", "b", "c"] * 9 + ["", None]), "date_unixtime": n * 10 if rng.random() < 0.98 else rng.choice([0, 5]), "text_plain": rng.choice(["hi", "yes", "no"] * 6 + ["", " ‏", None]), "reply_to_message_id": rng.choice([None, rng.randrange(max(1, n - 9), n) if n > 1 else None, None if n % 40 else n + 3, 5000 if n % 50 == 0 else None])})
    rows += [{"id": 1000 + n, "from_id": "ab"[n % 2], "date_unixtime": 10_000 + n, "text_plain": "deep", "reply_to_message_id": 999 + n if n else None} for n in range(60)]
    rows += [{"id": 2000, "from_id": "a", "date_unixtime": 7, "text_plain": "x", "reply_to_message_id": 2001}, {"id": 2001, "from_id": "b", "date_unixtime": 7, "text_plain": "x", "reply_to_message_id": 2000}]
    got = conversations(chat(*rows, {"id": None, "from_id": "z"}).withColumn("role", F.lit(1)).withColumn("node", F.lit(1)), queue, local)
    assert sorted((r.root_id, r.turn_no, r.message_id, r.role) for r in got.collect()) == expected_turns(rows)
    assert conversations(chat()).count() == 0


def test_queues_emit_what_is_freed_and_leave_loops():
    nodes, parents = np.array([1, 2, 3, 4, 7, 8, 9]), np.array([99, 1, 2, 1, 8, 7, 8])
    top, wave = C._queued(nodes, parents, np.arange(7))
    assert top.tolist() == [0, 0, 0, 0, -1, -1, -1] and wave.tolist()[:4] == [0, 1, 2, 1]


# ---- similar vectors


def clustered(n, seed=1, size=4, noise=0.15):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(n // size, 64))
    points = np.repeat(centres, size, axis=0) + noise * random_.normal(size=(n // size * size, 64))
    points *= random_.uniform(0.2, 5, (len(points), 1))
    return points.astype(np.float32)


def brute(points, least=0.9, nearest=5):
    unit = points.astype(float) / np.linalg.norm(points, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :nearest]
    return {tuple(sorted((i, int(j)))) for i in range(len(points)) for j in top[i] if s[i, j] >= least}


def frame(spark, points, space="m/a"):
    return spark.createDataFrame([(space, i, [float(x) for x in p]) for i, p in enumerate(points)], "space string, key long, embedding array<float>")


def pairs_of(df):
    return {(r.key_a, r.key_b) for r in df.select("key_a", "key_b").collect()}


def test_nearest_pairs_match_brute_force(spark):
    points = clustered(400)
    wanted = brute(points)
    assert pairs_of(N.similar_pairs(frame(spark, points), 400)) == wanted
    assert pairs_of(N.similar_pairs(frame(spark, points), 400, exact=True, block_rows=(50, 50))) == wanted
    got = pairs_of(N.similar_pairs(frame(spark, points), 400, cell_rows=10, block_rows=(60, 60)))
    assert got <= wanted and len(got) >= 0.97 * len(wanted)


def test_large_blocks_are_cut_and_dense_cells_multiplied_in_float(spark, monkeypatch):
    monkeypatch.setattr(N, "CUT_BLOCKS", 1)
    points = np.concatenate([clustered(120), clustered(40, seed=2, size=40, noise=0.02)])
    assert pairs_of(N.similar_pairs(frame(spark, points), len(points), block_rows=(64, 64), dense_rows=8)) == brute(points)
    assert pairs_of(N.similar_pairs(frame(spark, points), len(points), cell_rows=4, block_rows=(1000, 1000), recall=0.999, dense_rows=8)) >= {p for p in brute(points) if p[0] >= 120}


def test_rows_that_met_in_a_big_cell_are_not_multiplied_again():
    points = np.concatenate([clustered(60), clustered(40, seed=2, size=40, noise=0.01)])
    unit = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    codes, scale, rest = N.quantise(unit)
    keys, side = np.arange(len(unit)), np.zeros(len(unit), np.int8)
    cells = N.plan_for(len(unit), 0.9, cell_rows=5).cells
    low, high, thick = N._block_pairs(keys, codes, scale, rest, side, cells, 0.9, 5, 5)
    assert len(cells) > 1 and len(thick) == 0
    found = set(zip(low.tolist(), high.tolist(), strict=True))
    assert {p for p in brute(points) if p[0] >= 60} <= found and len({p for p in brute(points)} - found) <= 0.03 * len(brute(points))


def test_unusable_repeated_and_equal_vectors(spark):
    points = clustered(40)
    nan = [float("nan")] + [1.0] * 63
    odd = [("m/a", 900, None), ("m/a", 901, [0.0] * 64), ("m/a", 902, nan), ("m/a", 903, [1.0] * 3), ("m/a", None, [1.0] * 64), ("m/a", 904, [None] + [1.0] * 63)]
    rows = frame(spark, points).unionByName(frame(spark, points[:10])).unionByName(spark.createDataFrame(odd, "space string, key long, embedding array<float>"))
    assert pairs_of(N.similar_pairs(rows, 60)) == brute(points)
    copies = np.repeat(points[:1], 30, axis=0)
    got = pairs_of(N.similar_pairs(frame(spark, copies), 30))
    assert got == {(a, b) for a in range(5) for b in range(a + 1, 30)} | {(a, b) for a in range(6) for b in range(a + 1, 6)}
    assert N.similar_pairs(frame(spark, points).where("false"), 0).count() == 0
    both = frame(spark, points[:8], "m/a").unionByName(frame(spark, points[:8], "n/a"))
    assert N.similar_pairs(both, 16).select("space").distinct().count() == 2


def test_largest_with_ties():
    rng = np.random.default_rng(3)
    for _ in range(30):
        product = rng.integers(0, 4, (6, 12)).astype(float)
        wanted = np.argsort(-product, axis=1, kind="stable")[:, :5]
        assert [set(r) for r in N._largest(product, 5).tolist()] == [set(r) for r in wanted.tolist()]


@pytest.mark.parametrize("rows", [25_000, 252_000, 2_500_000, 100_000_000, 1_000_000_000, 10_000_000_000])
def test_the_plan_keeps_its_recall_at_any_size(rows):
    plan = N.plan_for(rows, 0.9)
    random_ = np.random.default_rng(8)
    x = random_.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random_.normal(size=(1500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = (0.9 * x + np.sqrt(1 - 0.81) * z).astype(np.float32)
    x = x.astype(np.float32)
    within = np.any([N._cell_of(x, parts) == N._cell_of(y, parts) for parts in plan.cells], axis=0)
    met = np.any([N._cell_of(x, parts) == N._cell_of(y, parts) for parts in plan.blocks], axis=0) & within
    assert met.mean() > 0.95 and plan.recall >= 0.99


# ---- personal data

PEOPLE = [("Xanel", "Brimsdottar"), ("Corsa", "O'Tarven"), ("Lurik", "Jastrow-Venn"), ("Tovrik", "Kestlemar"), ("", None)]
CASES = [
    ("write to hestra_51@korvane.example or bob [at] mail [dot] example, thanks", "email email"),
    ("mail <a.b+c@x.test> or mailto:c@d.invalid or e @ f.test", "email email email"),
    ("chatlib@2.56.1 and server at 192.0.2.52 and @jorvan_61 and https://x.example/p/4306", ""),
    ("+1 646 555 0177, (447) 555-0179 or 1-273-555-0126 ext. 30", "phone phone phone"),
    ("00 44 20 7946 0485; +49 30 23125 943; 01 99 00 42 44; 07700 900 353; +１ ８７８ ５５５ ０１７０; 736.555.0191", "phone phone phone phone phone phone"),
    ("ticket 3339652083, order no. 432954365, epoch 1769019069, isbn 000-0-56886-833-0, 1,227,736 and 2024-03-26", ""),
    ("invoice #55427702, serial XK-643-4637, build 71294463-8824, offset 12.2646, 98.9402", ""),
    ("passport QQ623027B and XQ9022636; my social is 666-46-4361 haha", "id_number id_number id_number"),
    ("my insurance wants 666857885 on every page", "id_number"),
    ("найден паспорт 00 39 517533 возле баков", "id_number"),
    ("תעודת זהות 993262831 נמצאה ליד הפחים", "id_number"),
    ("meet at 9b wigarelygate lane, Unit 1A or Flat 6, 100 Hollin Road.", "address address"),
    ("lane 9 of the pool; room 14 in the Crescent Building; 12 calls on the way home", ""),
    ("Treffpunkt ist Tannhofstr. 128a; wir wohnen Am Grauen Steg 111b", "address address"),
    ("nos mudamos a Calle del Almendrón 46, 3.º B y C/ Molino Hondo 9", "address address"),
    ("rendez-vous au 83 bis avenue du Grand-Merle, sonnez", "address"),
    ("мы переехали на улица Дальнего Луга, д. 214, кв. 30, заходите", "address"),
    ("עברנו לגור ברח' נחל צפרירון 41, דירה 23, מוזמנים", "address"),
    ("signed: Brimsdottar, Xanel and corsa o'tarven, both from the third floor", "name name"),
    ("X. Brimsdottar met LURIK JASTROW-VENN and Tovrik H. Kestlemar", "name name name"),
    ("Xanel laughed, the Grey Heron Bakery closes at 6", ""),
    ("the plumber is called abbratem quitem, number unknown", "name"),
    ("меня зовут Товрик Кестлемар; спасибо Товрику", "name"),
    ("my name is Melda and I just joined", ""),
    ("Yesterday I spoke to Margaret Whitfield", "name"),
    ("Thanks to Paul Hargreaves and Anna Lindqvist for the ladder", "name name"),
    ("hey, Maria da Quennova is looking for her bag", "name"),
    ("please call 212 555 0147 after six", "phone"),
    ("我住在中山路12号3室", "address"),
    ("Dorvelly Street was closed, the Vorlen Bakery too", ""),
]


@pytest.fixture(scope="module")
def names(spark):
    chatter = spark.createDataFrame([(text.lower(),) for text, _ in CASES if "mar" not in text.lower() and "paul" not in text.lower() and "abbr" not in text] * 2, "text string")
    return P.known_names(spark.createDataFrame(PEOPLE, "first_name string, last_name string"), chatter)


def test_a_large_set_of_names_is_joined(spark, names):
    people = spark.createDataFrame(PEOPLE, "first_name string, last_name string")
    rows = spark.createDataFrame([("f", str(n), text) for n, (text, _) in enumerate(CASES)] + [("f", None, None), ("f", "x", "")], "field string, record_key string, text string")
    joined = P.known_names(people, rows, limit=1)
    assert not isinstance(joined, Words)
    got, wanted = (P.personal_data(rows, n).select("field", "record_key", "kind", "nth", "start").collect() for n in (joined, P.known_names(people, rows)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and len(got) > 20


def test_common_words_are_a_share_of_the_rows(spark):
    rows = spark.createDataFrame([("the Storm came",), ("the storm left",), ("The calm",), (None,), ("",)], "text string")
    assert {r.word for r in P.common_words(rows).collect()} == {"c:the", "l:the", "c:storm"}


def test_different_names_are_different_entities(spark):
    people = ["hestra almasen", "istra almasen", "ostra almasen", "Dan Cohen", "Dana Kohn", "Don Cohn", "Tovrik Kestlemar", "Товрик Кестлемар", "Товрику Кестлемару", "KESTLEMAR, Tovrik"]
    got = {r.piece: r for r in P.surrogates(spark.createDataFrame([("name", p) for p in people], "kind string, piece string"), "k").collect()}
    assert len({got[p].entity for p in people[:6]}) == 6 and len({got[p].entity for p in people[6:]}) == 1
    fakes = {P.canonical("name", P.surrogate("k", "name", r.entity, r.piece, r.attempt)) for p, r in got.items() if p in people[:6]}
    assert len(fakes) == 6 and not fakes & {P.canonical("name", p) for p in people}


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds_of_pieces(names, text, kinds):
    assert " ".join(kind for *_, kind in P.Finder(names).pieces(text)) == kinds


def test_pieces_are_numbered_and_replaced(spark, names):
    text = "Tovrik Kestlemar, +1 646 555 0177 or +1 646 555 0178; Kestlemar, Tovrik"
    rows = spark.createDataFrame([("f", "1", text), ("f", "2", None), ("f", "3", ""), ("f", "4", "call +1 (646) 555-0177"), ("g", None, "nothing")], "field string, record_key string, text string")
    pieces = P.personal_data(rows, names)
    assert sorted((r.record_key, r.kind, r.nth) for r in pieces.collect()) == [("1", "name", 1), ("1", "name", 2), ("1", "phone", 1), ("1", "phone", 2), ("4", "phone", 1)]
    out = {(r.field, r.record_key): r.text for r in P.redacted(rows, pieces, "k").collect()}
    first = out["f", "1"]
    assert "Kestlemar" not in first and "0177" not in first and first.count("[NAME ") == 2 and first.count("[PHONE +1 ") == 2
    one, two = re.findall(r"\[NAME ([^\]]+)\]", first)
    assert sorted(re.findall(r"\w+", one)) == sorted(re.findall(r"\w+", two)) and "," in two
    digits = [re.sub(r"\D", "", p) for p in re.findall(r"\[PHONE ([^\]]+)\]", first + out["f", "4"])]
    assert digits[0] != digits[1] and digits[0] == digits[2]
    assert out["f", "2"] is None and out["f", "3"] == "" and out["g", None] == "nothing"


def test_surrogates_stay_distinct(spark):
    pieces = spark.createDataFrame([("id_number", f"A{n}") for n in range(9)] + [("id_number", f"B{n}") for n in range(9)], "kind string, piece string")
    got = P.surrogates(pieces, "key", rounds=60).collect()
    fakes = [P.surrogate("key", r.kind, r.entity, r.entity, r.attempt) for r in got]
    assert len(set(fakes)) == len(fakes) == 18


def test_surrogates_of_a_small_space_stay_distinct(spark):
    streets = [("address", f"{n} {word} St") for word in ("Oak", "Elm", "Fir", "Ash", "Bay", "Ivy") for n in range(1, 10)]
    spelled = [("address", "1 OAK ST."), ("email", "a@x.test"), ("phone", "+1 646 555 0177"), ("phone", "+1 (646) 555-0177")]
    rows = spark.createDataFrame(streets + spelled, "kind string, piece string")
    for key in ("k", "key", "other"):
        attempts = {(r.kind, r.entity): r.attempt for r in P.surrogates(rows, key).collect()}
        assert len(attempts) == len(streets) + 2
        owners = {}
        for kind, piece in streets + spelled:
            entity = P.canonical(kind, piece)
            owners.setdefault((kind, P.surrogate(key, kind, entity, piece, attempts[kind, entity])), set()).add(entity)
        assert all(len(entities) == 1 for entities in owners.values())


def test_more_entities_than_surrogates(spark):
    streets = [f"{n} Oak St" for n in range(10)]
    got = P.surrogates(spark.createDataFrame([("address", s) for s in streets], "kind string, piece string"), "key").collect()
    attempts = {r.entity: r.attempt for r in got}
    fakes = {P.surrogate("key", "address", P.canonical("address", s), s, attempts[P.canonical("address", s)]) for s in streets}
    assert len(got) == len(fakes) == 10 and max(attempts.values()) > P.NUMBERED
    assert P.surrogate("k", "email", "x", "a@b.test", P.NUMBERED + 7).endswith("+7@example.org")


def test_surrogates_keep_script_case_and_format():
    assert re.fullmatch(r"[א-ת]+ [א-ת]+", P.surrogate("k", "name", "x", "טובריק קסטלמר"))
    assert P.surrogate("k", "name", "x", "TOVRIK KESTLEMAR").isupper() and P.surrogate("k", "name", "x", "Melda Zellanova").split()[1].endswith("na")
    assert re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]", P.surrogate("k", "id_number", "x", "QQ 60 32 97 B"))
    assert P.skeleton("Kestlemar") == P.skeleton("Кестлемар") == P.skeleton("קסטלמר")


# ---- languages

SENTENCES = {
    "en": ["the neighbours moved the old table before the storm", "nobody told me where they put the meeting notes", "our friends were counting chairs after lunch", "please stop asking about the water bill again", "who has the keys of the garden house today"],
    "de": ["die nachbarn haben den alten tisch vor dem gewitter bewegt", "niemand sagte mir wo sie die notizen hingelegt haben", "unsere freunde zählten die stühle nach dem essen", "bitte fragt nicht mehr nach der wasserrechnung", "wer hat heute die schlüssel vom gartenhaus"],
    "es": ["los vecinos movieron la mesa vieja antes de la tormenta", "nadie me dijo dónde pusieron las notas de la reunión", "nuestros amigos contaban las sillas después de comer", "dejad de preguntar por la factura del agua otra vez", "quién tiene hoy las llaves de la casa del jardín"],
    "fr": ["les voisins ont déplacé la vieille table avant l'orage", "personne ne m'a dit où ils ont mis les notes de la réunion", "nos amis comptaient les chaises après le repas", "arrêtez de demander encore la facture d'eau", "qui a les clés de la maison du jardin aujourd'hui"],
    "ru": ["соседи передвинули старый стол перед грозой", "никто не сказал мне куда они положили заметки", "наши друзья считали стулья сразу после обеда", "перестаньте спрашивать про счёт за воду", "у кого сегодня ключи от садового дома"],
    "he": ["השכנים הזיזו את השולחן הישן לפני הסערה", "אף אחד לא אמר לי איפה שמו את סיכום הישיבה", "החברים שלנו ספרו את הכיסאות אחרי הצהריים", "בבקשה תפסיקו לשאול על חשבון המים", "למי יש היום את המפתחות של בית הגינה"],
}


@pytest.fixture(scope="module")
def model():
    texts = [(s, lang) for lang, all_ in SENTENCES.items() for s in all_ for _ in range(3)] + [(SENTENCES["en"][0], "ru"), (SENTENCES["de"][1], "en")]
    return L.train([t for t, _ in texts], [lang for _, lang in texts], rounds=20)


def test_codewords_are_apart():
    code = L.code_matrix()
    assert min((code[a] != code[b]).sum() for a in range(9) for b in range(a)) >= 5


def test_segments_of_mixed_texts(model):
    def langs(text):
        return L.classify(model, [text]).lang.tolist()

    assert [langs(s[-1]) for s in SENTENCES.values()] == [[lang] for lang in SENTENCES]
    assert langs(SENTENCES["en"][1] + ". " + SENTENCES["ru"][2] + "\n" + SENTENCES["en"][4]) == ["en", "ru", "en"]
    assert langs(SENTENCES["he"][0] + " «deadline» " + SENTENCES["he"][1]) == ["he"]
    assert langs("too short") == [] and langs(None) == [] and langs("") == []
    assert langs("https://example.org/some/very/long/link/with/many/letters @handle #hashtag") == []
    found = L.classify(model, [SENTENCES["de"][0]])
    assert 0 < found.confidence[0] <= 1


def test_short_stretches_join_their_surroundings():
    assert L._merged([["es", 11, 0, 3], ["en", 16, 3, 5], ["es", 18, 5, 9]]) == [["es", 45, 0, 9]]
    assert [r[0] for r in L._merged([["en", 30, 0, 3], ["fr", 5, 3, 4], ["de", 40, 4, 9]])] == ["en", "de"]
    assert [r[0] for r in L._merged([["en", 5, 0, 1], ["fr", 9, 1, 2], ["de", 8, 2, 3]])] in (["fr"], ["de"])


def test_labels():
    assert [L.named_language(x) for x in ("EN", "iw", "he-IL", "ru_RU", "Ukrainian", "ger", "und", "", None, "xx")] == ["en", "he", "he", "ru", "uk", "de", None, None, None, None]


def test_wrong_labels_in_a_table(spark, model):
    rows = [(1, SENTENCES["en"][0], "en", "A"), (2, SENTENCES["en"][1], "de-AT", "A"), (3, SENTENCES["ru"][0] + " " + SENTENCES["de"][0], "ru", "Anna Stuhl"), (4, None, None, None), (5, SENTENCES["fr"][2], None, "B"), (6, "ok", "ru", "B")]
    df = spark.createDataFrame(rows, "delivery_id long, text_plain string, lang string, from_name string").withColumn("known", F.lit("clash"))
    for shared in (100, 1):
        found = L.wrong_labels(L.language_segments(df, model=model, shared_words=shared)).select("delivery_id", "segment_no", "lang")
        assert sorted(tuple(r) for r in found.collect()) == [(2, 1, "en"), (3, 1, "ru"), (3, 2, "de"), (5, 1, "fr")]


def test_training_sample_is_bounded(spark):
    rows = [(n, f"some longer english text number {n}", "English") for n in range(300)] + [(n, "короткий но достаточно длинный текст", "ru") for n in range(300)] + [(n, f"ein seltener deutscher text, nummer {'abc'[n]}", "de") for n in range(3)]
    df = spark.createDataFrame(rows, "delivery_id long, text_plain string, lang string").repartition(7)
    texts, labels = L.training_sample(df, per_language=20)
    assert labels.count("en") == 20 and labels.count("ru") == 1 and labels.count("de") == 3
    place = lambda t: df.where(F.col("text_plain").startswith(t)).select(F.xxhash64("text_plain")).first()[0]
    smallest = df.where("lang = 'English'").select(F.xxhash64("text_plain").alias("place")).orderBy("place").limit(20).collect()
    assert len(smallest) == 20 and place("ein") is not None
    long = spark.createDataFrame([(1, "anfang " * 900 + "ende " * 900, "de")], "delivery_id long, text_plain string, lang string")
    words = L.training_sample(long)[0][0].split()
    assert len(words) <= L.SAMPLE_WORDS and {"anfang", "ende"} == set(words)


def test_prints_are_those_of_the_engine(spark):
    words = ["a", "Zelmira", "שלום", "x" * 100, ""]
    theirs = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert [fingerprint(w) for w in words] == theirs
    some = Words(np.array(theirs[:2]))
    assert fingerprint("a") in some and fingerprint("b") not in some and some.among(["b", "a"]).tolist() == [False, True]
    assert isinstance(word_set(spark.createDataFrame([("a",), ("a",), (None,)], "word string"), limit=1), Words)


def test_a_large_set_of_names_gives_no_wrong_hits():
    rng = np.random.default_rng(1)
    names = Words(rng.integers(-(2**63), 2**63 - 1, 10_000_000))
    assert not names.among(f"word{n}" for n in range(200_000)).any()


# ---- leakage


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{n}" for n in range(30)]
    items = [(n, " ".join(rng.choices(vocabulary, k=30))) for n in range(12)] + [(50, None), (51, "short one"), (None, " ".join(vocabulary))]
    docs = []
    for n in range(60):
        words = rng.choices(vocabulary, k=40)
        if n % 3 == 0:
            item = items[n % 12][1].split()
            k = rng.choice([11, 12, 20])
            at = rng.randrange(0, 30 - k + 1)
            words[5:5] = item[at : at + k]
        docs.append((n, " ".join(words)))
    docs += [(100, ""), (101, None), (102, "W0, w1; " * 20)]
    wanted = set()
    for d, text in docs:
        grams = {tuple(w[i : i + 12]) for w in [words_of(text)] for i in range(len(w) - 11)}
        for i, item in items:
            w = words_of(item)
            if i is not None and any(tuple(w[j : j + 12]) in grams for j in range(len(w) - 11)):
                wanted.add((d, i))
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = leaked_passages(documents, tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and all(r.n_words >= 12 for r in got)
    sliced = leaked_passages(documents, tests, item_bytes=300).collect()
    assert sorted(map(tuple, sliced), key=str) == sorted(map(tuple, got), key=str)
    texts = dict(docs)
    for r in got:
        doc, item = words_of(texts[r.doc_id]), " ".join(words_of(dict(items)[r.item_id]))
        runs = [(n, -i) for i in range(len(doc)) for n in range(12, len(doc) - i + 1) if f" {' '.join(doc[i : i + n])} " in f" {item} "]
        assert max(runs) == (r.n_words, -r.word_pos)
    assert without_leaks(documents, tests).count() == len(docs) - len({d for d, _ in wanted})
    assert leaked_passages(documents.where("false"), tests).count() == 0 and leaked_passages(documents, tests.where("false")).count() == 0


def test_leaks_of_one_word_repeated_take_linear_time():
    suffixes = TestSuffixes([1, 2], ["echo " * 10_000, "other " * 30 + "echo " * 12], 12)
    codes = np.array([suffixes.vocabulary["echo"]] * 10_000 + [0], np.int64)
    began = time.time()
    corpus, test, length = suffixes.search(codes)
    assert time.time() - began < 5 and len(corpus) < 60_000
    assert length[suffixes.owners[test] == 0].max() == 10_000 and length[suffixes.owners[test] == 1].max() == 12


def test_disguised_words():
    assert words_of("pa​inted Ｎo⁠body—CAFÉ ﬁne x_y") == ["painted", "nobody", "cafe", "fine", "x", "y"]


# ---- mixing


def test_shares_are_met_where_they_can_be(spark):
    rng = random.Random(8)
    docs = [(n, rng.choice(["a", " A ", "a"] * 6 + ["b", "B-b", "c", None]), "word " * rng.randrange(1, 40)) for n in range(900)] + [(1000, "a", ""), (1001, "b", None)]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(-1)).withColumn("block", F.lit(0))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixed(documents, targets, budget=4000).cache()
    rows = mix.collect()
    total = sum(r.n_tokens for r in rows)
    assert 4000 - 60 < total <= 4000 and len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    assert {r.doc_id for r in rows if r.repeat_no == 2} <= {r.doc_id for r in rows if r.repeat_no == 1}
    report = {r.source: r for r in share_report(mix, targets).collect()}
    limit = {"b": 3, "c": 2}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        r = report[source]
        assert r.most_repeats <= limit.get(source, 1)
        assert abs(r.actual_share - share) < 0.03 or r.most_repeats == limit.get(source, 1)
    assert report["gone"].n_tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert mixed(documents.where("false"), targets).count() == 0


def test_the_default_budget_is_a_share_of_the_tokens(spark):
    docs = [(n, "abc"[n % 3], "word " * 10) for n in range(600)] + [(1000 + n, "tiny", "word " * 10) for n in range(3)]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.15, 1), ("tiny", 0.1, 2), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in share_report(mixed(documents, targets), targets, documents).collect()}
    tokens = {s: r.n_tokens for s, r in report.items()}
    size = tokens["tiny"] / 6
    assert 603 * size / 2 - size < sum(tokens.values()) <= 603 * size / 2
    assert abs(tokens["b"] - tokens["a"] * 0.5) <= 2 * size and abs(tokens["c"] - tokens["a"] * 0.3) <= 2 * size
    assert {s: r.missed for s, r in report.items()} == {"a": None, "b": None, "c": None, "tiny": "used up", "absent": "no documents"}


def test_one_source_of_little_weight_does_not_fill_one_range(spark):
    docs = [(n, "a" if n else "small", "word " * 3) for n in range(2000)]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.999, 1), ("small", 0.001, 1)], "source string, target_share double, max_repeats int")
    rows = mixed(documents, targets, budget=100_000).collect()
    assert len(rows) == 2000 and [r.finish for r in sorted(rows, key=lambda r: r.finish)][-1] == max(r.finish for r in rows)


def test_token_counts_are_those_of_the_tokenizer(spark):
    rows = spark.createDataFrame([(1, "s", "Hello, wörld! שלום"), (2, "s", None)], "doc_id long, source string, text string")
    counts = {r.doc_id: r.n_tokens for r in with_tokens(rows).collect()}
    assert counts[2] == 0 and 4 <= counts[1] <= 20


# ---- sentences

SPLIT = [
    "Dr. Fenwarrick arrived at 9:55 p.m. and left.|The gate opens at 9 p.m.|The fee rose from 5.1 to 16.1 percent, i.e. a bit.",
    "Sales of Uxshi Inc. fell 28.8 pct. in Feb. and Mar. alone.|E. Q. Umberlitz et al. measured it.|Ph.D. students slept in tent B.|And then?|Really?!|What a mess!!!",
    'The sign read "Closed." and nobody came.|"Who has the key?" asked Corsa.|The guard said, "Leave. Now."|Chat.js, v3.5.1 and notes.v6.txt crashed.',
    "(The old key is with the guard.)|We waited ... and then left.|I don't know ...|Bring rope, etc.|The U.S. branch sent 63 boxes via Kolbra J. Gelthorn.",
    "It is fixed. 🚲|So 27 of us waited. ❤️|See www.example.com/faq?id=86 for the rest.",
    "Der Termin ist am 3. Mai um 3 Uhr, d. h. vor dem Fest.|Dr. Umberlitz wohnt z. B. gleich neben der Schule.|„Es reicht. Wir gehen“, sagte Zelmira.|Seile, Zelte usw.",
    "El Sr. Pellamore llegó a las 6:43 a. m. con la llave.|¿Quién tiene la llave del n.º 65?|«Basta. Nos vamos», dijo Lurik.",
    "M. Kestlemar arrive à 11 h.|« On y va ? » demande Corsa.|Cf. p. 16 du carnet, c.-à-d. la liste.",
    "А. Б. Морневик пришёл в 5.52 и сел.|Верёвки, лампы и т. д.|Двое ушли.|Встреча на ул. Заревой, д. 88, т. е. возле школы.|Ну и бардак!..|«Хватит. Уходим», — сказал Йорван.",
    "ד\"ר אלמסן הגיע בשעה 6:52 לבדוק.|\"זה עובד. אל תיגעו,\" כתבה טרביה.|ר' ורנהולם גר ברח' הדרורית 67.",
    "وصل د. ميسار عند الساعة 1:02 مساءً.|قال زلمار: \"انتهى. لا تلمسوه\" ثم خرج.|هل وصل؟",
    "डॉ. रिवान शाम 6:02 बजे आए।|चाबी नं. 27 किसके पास है?|“रुको। अभी नहीं,” रिवान ने लिखा।",
]
DENSE_SPLIT = ["他问：“好了吗？”然后走了。|“别动。马上好。”小朔写道。|小朔说：“等一下……”|家长们打印了报名表。|价格从3.5元涨到54.8元。", "「終わった？」と聞いて帰った。|「もう大丈夫。触らないで。」とソラベさんが書いた。|版3.7.2で直りました……。|やった！！"]


@pytest.mark.parametrize(("case", "gap"), [(c, " ") for c in SPLIT] + [(c, "") for c in DENSE_SPLIT])
def test_sentence_boundaries(case, gap):
    wanted = case.split("|")
    text = gap.join(wanted)
    assert [text[a:b] for a, b in split_sentences(text)] == wanted
    for lead in ("- ", "12. ", "## ", "> ", "[Tovrik O., 2023-05-16T13:10] "):
        line = lead + text
        assert [line[a:b] for a, b in split_sentences(line)] == [lead + wanted[0], *wanted[1:]]


def test_abbreviations_of_one_language_do_not_bind_another():
    for text in ("He told me. Then he left.", "Я сказал им. Потом мы ушли.", "This was his ex. Nobody was there."):
        assert len(split_sentences(text)) == 2
    assert len(split_sentences("Il est chez Me. Kestlemar avec une amie.")) == 1 and len(split_sentences("Мы идём в школу им. Пушкина и не на вокзал.")) == 1


@pytest.mark.parametrize("unit", ["Dr. Orn left at 5 p.m. today. ", "a.b.c. ", "a.", "“ x. ", '"a. b" c. ', "x. ”y ", "ก ข. ", "🚲 ", ". ", ".   *"])
def test_long_lines_take_linear_time(unit):
    began = time.time()
    assert split_sentences(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 8


def test_thai_lines_and_layout():
    text = "คุณมะลุนมาถึงตอน 6.56 น. เมื่อวาน คุณซาเรลืม ดีมากเลย! ใครมีกุญแจเบอร์ 96 บ้าง"
    assert [text[a:b] for a, b in split_sentences(text)] == ["คุณมะลุนมาถึงตอน 6.56 น. เมื่อวาน", "คุณซาเรลืม", "ดีมากเลย!", "ใครมีกุญแจเบอร์ 96 บ้าง"]
    text = " one\n\n ​\n two words \r\nthree.Four "
    assert [text[a:b] for a, b in split_sentences(text)] == ["one", "two words", "three.", "Four"]
    assert split_sentences("") == split_sentences(None) == split_sentences(" \n") == []


def test_sentences_cover_all_visible_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab A.?!\n\"'“”«»(). 1。…🚲กข ", k=200)) for _ in range(50)]
    for text in texts:
        spans = split_sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == re.sub(r"\s", "", text) or any(c.isspace() for a, b in spans for c in text[a:b])
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (None, "x")], "doc_id long, text string").withColumn("start_pos", F.lit(0))
    assert sorted(((r.doc_id or 0), r.sentence_no, r.end_pos) for r in sentences(df).collect()) == [(0, 1, 1), (1, 1, 4), (1, 1, 4), (1, 2, 9), (1, 2, 9)]
