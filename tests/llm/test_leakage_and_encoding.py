import random
import unicodedata

from codestrata.llm import encoding, leakage
from conftest import rows


def test_words():
    assert leakage.words("ＡＢ\u200bc  Ｄ_e1\u00adf! ﬁne") == ["abc", "d", "e1f", "fine"]
    assert leakage.words(unicodedata.normalize("NFD", "Été déjà")) == ["été", "déjà"]
    assert leakage.words(None) == leakage.words("") == leakage.words("--- ...") == []


def brute(docs, items, run=12):
    grams = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return sorted({(d, i) for d, t in docs for w in [leakage.words(t)] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}, key=repr)


def test_one_character_may_hold_many_words(spark):
    squares = "\u3300\u3314\u334d\ufdfa" * 2  # compatibility composition spells them out
    n = len(leakage.words(squares))
    d = spark.createDataFrame([(1, squares), (2, squares[:1])], "doc_id long, text string")
    i = spark.createDataFrame([(7, unicodedata.normalize("NFKC", squares))], "item_id long, text string")
    assert n >= 6 and rows(leakage.leaks(d, i, run=6, width=5)) == [(1, 7)]


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([5, 12, 13, 40]))) for i in range(40)] + [(100, "a " * 40), (101, None), (102, ""), (103, "short one")]
    items.append((104, items[3][1]))
    docs = [(i, text(60)) for i in range(60)] + [(900, None), (901, ""), (902, "a " * 11), (903, "A, " * 12)]
    for k in range(80):
        w = items[rng.randrange(40)][1].split()
        n = rng.choice([10, 11, 12, 13, len(w)])
        at = rng.randrange(max(1, len(w) - n + 1))
        docs.append((200 + k, text(rng.randrange(30)) + "\n" + rng.choice([" ", "-", ", "]).join(w[at : at + n]).upper() + " " + text(rng.randrange(200))))
    docs.append(docs[70])
    d = spark.createDataFrame([(*x, 0, "z") for x in docs], "doc_id long, text string, pos int, shingle string")
    i = spark.createDataFrame([(*x, 0) for x in [*items, items[0]]], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert want and rows(leakage.leaks(d, i), "doc_id", "item_id") == want
    assert rows(leakage.leaks(d, i, index_shingles=0), "doc_id", "item_id") == want  # by shuffle
    monkeypatch.setattr(leakage, "HOT_HITS", 3)
    monkeypatch.setattr(leakage, "PLACES", 2)
    assert rows(leakage.leaks(d, i, index_shingles=0), "doc_id", "item_id") == want  # hot shingles in parts
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d, i.where("item_id BETWEEN 101 AND 103"))):
        assert leakage.leaks(a, b).count() == 0


CLEAN = ["Für große Projekte dauert die Prüfung länger, während die Übersicht größtenteils überflüssig wäre.", "Voilà pourquoi la mémoire est saturée après la dernière révision du dépôt.",
         "La búsqueda tardó más de lo habitual según el análisis; ningún autor modificó el módulo.", "Функция вызывается только из тестов, её можно удалить без последствий.",
         "It’s the “viewer” panel — café, naïve façade → 5 µs ±3 %.", "São necessárias três confirmações antes da remoção; a função não é chamada."]
QUOTES = ["Encoding test: the string ñ must never be shown as \"Ã±\" by the viewer.", "Common symptom table: é turning into Ã© means that the wrong code page was chosen.", "Users on old terminals may see `Ã¼` where “ü” was meant; that is a display problem."]


def test_garbled_texts_are_found_and_restored(spark):
    rng = random.Random(1)
    docs, truth = [], {}
    for i in range(600):
        text = " ".join(rng.choice(CLEAN) for _ in range(3))
        bad = text
        if i % 10 == 0:
            page = rng.choice(["cp1252", "cp437", "mac_roman", "latin-1"])
            bad = text.encode("utf-8").decode(page, "ignore") if page == "cp1252" else text.encode("utf-8").decode(page)
            truth[i] = text
        elif i % 97 == 1:
            bad = text.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
            truth[i] = text
        elif i % 50 == 3:
            bad = QUOTES[i % 3]
        docs.append((i, bad, rng.choice(["a", "b", None]), "x"))
    docs += [(9000, None, "a", "x"), (9001, "", "a", "x"), (9002, "plain ascii", "a", "x"), (9003, "pr\ufffdsente", "a", "x"), docs[10], (None, "Ã¼ber", "a", "x"), ((1 << 60) + 1, "fÃ¼r groÃŸe PrÃ¼fung", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, word string")
    got = {r["doc_id"]: r for r in encoding.garbled(df).collect()}
    assert set(got) == set(truth) | {9003, None, (1 << 60) + 1} and got[9003]["chain"] == encoding.LOST
    exact = sum(got[i]["restored"] == t for i, t in truth.items())
    assert exact >= 0.75 * len(truth)  # bytes that the wrong page lacks were dropped and can't come back
    assert encoding.garbled(df.limit(0)).count() == 0


def test_one_garbled_place_shows_in_a_long_text(spark):
    rng = random.Random(5)
    russian = ["Функция вызывается только из тестов, её можно удалить без последствий.", "Модуль читает настройки при запуске и хранит их до конца работы.", "Большие файлы загружаются частями, чтобы память не росла."]
    docs = [(i, " ".join(rng.choice(russian) for _ in range(rng.randrange(2, 90))), "a") for i in range(200)]
    text = " ".join(russian * 30)
    half = len(text) // 2
    at = text.index(russian[1], half)
    bad = text[:at] + russian[1].encode("koi8_r").decode("cp1251") + text[at + len(russian[1]) :]
    docs += [(900, bad, "a"), (901, text, "a"), (902, bad + " " + bad, "a")]
    got = {r["doc_id"]: r for r in encoding.garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert set(got) == {900, 902} and got[900]["chain"] == "koi8_r>cp1251"
    assert got[900]["restored"] == text and got[902]["restored"] == text + " " + text
    assert encoding.places([1, -1, -1, 9, -1, 8, -20, 12, -3], 10) == [(3, 5, 16), (7, 7, 12)]


def test_chains_undo_what_they_name():
    for text in ("größtenteils", "l’été"):
        for page in ("latin-1", "mac_roman", "cp437", "cp850"):
            assert encoding.chains()[f"utf-8>{page}"](text.encode("utf-8").decode(page)) == text
    word = "Функция"
    assert encoding.chains()["koi8_r>cp1251"](word.encode("koi8_r").decode("cp1251")) == word
    assert encoding.chains()["cp1251>cp1252"](word.encode("cp1251").decode("cp1252")) == word
    assert all(u("ascii") is None for u in encoding.chains().values())


def test_a_source_for_each_text(spark, monkeypatch):
    texts = [(i, " ".join(CLEAN[k % 6] for k in (i, i + 1)), f"s{i}") for i in range(120)] + [(500 + i, CLEAN[i % 4].encode().decode("latin-1"), f"t{i}") for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    learned, rates = encoding.learn(df)
    assert rates.count() == 126 and set(learned.shared) == {encoding.INTACT, *encoding.chains()}  # what came to the driver has no sources in it
    assert {r["doc_id"] for r in encoding.garbled(df).collect()} == set(range(500, 506))


def test_long_quoted_examples():
    long = "приветствие".encode().decode("cp1252", "replace").replace("\ufffd", "")
    good = "größenübersicht".encode().decode("latin-1")
    assert encoding.quoted(f'Encoding test: "é" and "{"éèüöäßñ".encode().decode("latin-1")}" are the same word to that viewer.') and not encoding.quoted(f"{good} {long}")
