import random

import pytest
from pyspark.sql import functions as F

from quern.llm.langid import LANGUAGES, fit, identify_languages, label_code, label_errors

TEXTS = {
    "de": "die anleihe wurde am markt gut aufgenommen und der kupon liegt über dem der letzten emission nach angaben der banken bleibt die nachfrage hoch wobei private anleger einen großen teil erhielten",
    "en": "the issuer placed its bonds with strong demand from investors while the spread to government paper fell and the board approved a new coupon after the call with holders despite outflows from the sector",
    "es": "el emisor colocó los bonos con una demanda alta de los inversores mientras la liquidez sigue por debajo de lo esperado y la deuda neta aumentó según los bancos durante la gira del trimestre",
    "fr": "la société a remboursé la totalité de ses titres auprès des porteurs et le taux du coupon a été fixé avant le règlement même si la liquidité reste faible selon les banques de file du marché",
    "kk": "компания ұстаушылардан қағаз сатып алды және несие берушілер алдындағы міндеттер орындалуда сұраныс ұсыныстан асып түсті жеке инвесторлардың үлесі болды өтінім қабылдауды бастады",
    "ru": "эмитент разместил выпуск облигаций и закрыл книгу заявок ставка первого купона оказалась ниже ориентира а спрос инвесторов превысил предложение по словам организаторов сделки на рынке",
    "tr": "şirket yatırımcılardan tahvil geri aldı ve kupon oranını belirledi alacaklılara verilen sözler tutuluyor talep arzın katına ulaştı ödeme ise planlanıyor bireysel yatırımcıların payı oldu",
    "uk": "емітент розмістив облігації і викупив у власників папери попит перевищив пропозицію приватні інвестори отримали лише частину розрахунки відбудуться хоча ліквідність не сягає потрібного рівня",
}


def sample(lang, n, rng):
    w = TEXTS[lang].split()
    return " ".join(rng.choice(w) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(sample(k, 25, rng), k if rng.random() > 0.1 else rng.choice(LANGUAGES)) for k in LANGUAGES for _ in range(60)]
    return fit(rows)


def test_held_out(spark, model):
    rng = random.Random(2)
    rows = [(i, sample(k, 20, rng), k) for i, k in enumerate(LANGUAGES * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify_languages(df, model).collect()}
    assert sum(got[i]["found_lang"] == k for i, _, k in rows) >= 0.98 * len(rows)
    assert sum(got[i]["confidence"] for i, _, k in rows) / len(rows) > 0.9


def test_passages_and_labels(spark, model):
    rng = random.Random(3)
    de, ru, en = (sample(k, 30, rng) for k in ("de", "ru", "en"))
    rows = [
        (1, de, "de"), (2, de, "DE"), (3, de, "deu"), (4, de, "en"), (5, de, None), (6, de, "unknown"), (7, f"{de.capitalize()}. {ru.capitalize()}.", "de"), (8, f"{ru}. {en}. {ru}", "ru"),
        (9, None, "ru"), (10, "", None), (11, "1234 5678 !!", None), (12, ru.upper(), "ru-RU"), (13, f"{de} Mednoprim Kapital RU000ZABC", "de_DE"), (14, (ru + " ") * 3000, "ru"), (14, (ru + " ") * 3000, "ru"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, found_lang int")
    found = identify_languages(df, model)
    assert found.count() == len(rows)
    p8 = {r["doc_id"]: [(p["lang"], p["words"]) for p in r["passages"]] for r in found.collect()}
    assert [k for k, _ in p8[8]] == ["ru", "en", "ru"] and all(abs(n - 30) <= 3 for _, n in p8[8])
    errors = sorted((r["doc_id"], r["found_lang"]) for r in label_errors(found).collect())
    assert errors == [(4, "de"), (5, "de"), (6, "de"), (7, "de"), (7, "ru"), (8, "en"), (8, "ru")]


def test_empty_and_codes(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify_languages(df).count() == 0
    one = spark.createDataFrame([(1, "нечто", "ru")], "doc_id long, text string, lang string")
    assert identify_languages(one).count() == 1
    codes = spark.createDataFrame([("ru-RU",), ("eng",), (" EN ",), ("en_GB",), ("-",), (None,), ("pt",), ("und",)], "l string").select(label_code(F.col("l"))).collect()
    assert [r[0] for r in codes] == ["ru", "en", "en", "en", None, None, "pt", None]
