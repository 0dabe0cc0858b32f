import pytest
from pyspark.sql import functions as F

from quern.llm.names import LONG, deletions, edit_distance, fold, keys_of, link_fields, plain, split_layout

ALIASES = [("ПАО «Жемчугоключ»", "Жемчугоключ"), ("ГК Сполохдар Фарм", "Сполохдар Фарм"), ("ГК Сполохдар Фарм", "Spolokhdar Farm"), ("МКПАО Новая Вольнозалив Логистика", "Новая Вольнозалив Логистика"), ("АО «Вольнопорт»", "Вольнопорт"), ("АО «Вольнопорт Транзит»", "Вольнопорт Транзит"), ("ГК Клёнодар", "KLEDA"), (None, "x"), ("ООО Рябиноконтур Финанс", None)]
VARIANTS = {
    "ПАО «Жемчугоключ»": ["Жемчугокюч", "ЖЕМЧУГОКЛЮЧОМ", "Жеmчугokлюч", ";tvxeujrk.x", "жемчугоклик", "корп. Жемчугоключ", "Zhemchugolyuch", "Жемчугоключовский"],
    "ГК Сполохдар Фарм": ["Фарм Сполохдар", "СполохдарФарм", "Сполохдар-Фарма (холдинг)", "Spolokhdarr Farm", "cgjkj[lfh afhv", "споло.хдар фарм"],
    "МКПАО Новая Вольнозалив Логистика": ["Новая Вольнозал. лог-ка", "Нофая Вольнозалив Логистика", "Вольнозалновлог", "логистика вольнозалив новая"],
    "АО «Вольнопорт Транзит»": ["Вольнопорт Транзитом", "Вольнопор Транзит"],
    "ООО Рябиноконтур Финанс": ["рябиноконт. фин.", "Рябинокантур Финанс"],
}


def test_links(spark):
    aliases = spark.createDataFrame(ALIASES, "issuer string, alias string")
    names = [(k, v) for k, vs in VARIANTS.items() for v in vs]
    fields = [("f", str(i), v, 1) for i, (_, v) in enumerate(names)] + [("f", "listed", "вольнопорт", 1), ("f", "out1", "Мигоферн Энерго", 1), ("f", "out2", "Тетразанг", 1), ("f", "null", None, 1), ("f", None, "Жемчугокюч", 1), ("f", "empty", "", 1), ("f", "long", "слово " * 5000, 1), ("f", "0", names[0][1], 1)]
    texts = [("p", "1", "Вчера холдинг Жемчугоключ разместил бумаги, а корп. Сполохдра Фарм ждёт; группа Вольнопорт включает 3 общества.", 1), ("p", "2", None, 1), ("p", "3", "", 1), ("p", "4", "Книга Жемчугоключу открыта; по Вольнопорт Транзит спред 5 б.п.", 1), ("p", "5", "Просто текст про облигации. " * 3000, 1)]
    df = spark.createDataFrame(fields, "tbl string, row_key string, name string, issuer int")
    tx = spark.createDataFrame(texts, "tbl string, row_key string, text string, issuer int")
    rows = link_fields(df, tx, aliases).collect()
    got = {r["row_key"]: r["issuer"] for r in rows if r["tbl"] == "f"}
    assert {v: (got.get(str(i)), k) for i, (k, v) in enumerate(names) if got.get(str(i)) != k} == {}
    assert set(got) == {str(i) for i in range(len(names))} | {"listed"} and all(r["listed"] == (r["row_key"] == "listed") for r in rows if r["tbl"] == "f")
    inside = {(r["row_key"], r["issuer"], r["listed"]) for r in rows if r["tbl"] == "p"}
    assert inside == {("1", "ПАО «Жемчугоключ»", True), ("1", "ГК Сполохдар Фарм", False), ("1", "АО «Вольнопорт»", True), ("4", "ПАО «Жемчугоключ»", False), ("4", "АО «Вольнопорт Транзит»", True)}


def test_empty(spark):
    aliases = spark.createDataFrame(ALIASES, "issuer string, alias string")
    df = spark.createDataFrame([("f", "1", "Жемчугокюч")], "tbl string, row_key string, name string")
    tx = spark.createDataFrame([("f", "1", "Жемчугокюч")], "tbl string, row_key string, text string")
    assert link_fields(df.limit(0), tx.limit(0), aliases).count() == 0
    assert link_fields(df, tx, aliases.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("абвг", "абвг", 0), ("абвг", "бавг", 1), ("абвг", "абг", 1), ("абвг", "абввг", 1), ("абвг", "ыбвю", 2), ("абвгд", "ю", 3)])
def test_edits(a, b, d):
    assert edit_distance(a, b) == d
    long_a, long_b = a + "жзиклмно", b + "жзиклмно"
    if d <= 2:
        assert set(deletions(long_a)) & set(deletions(long_b))


def test_forms():
    assert fold("zhemchugoklyuch") == fold("жемчугоключ") and fold("иckpoбaланc") == "искробаланс"
    assert plain("ПАО «Клёнодар-Агро»") == "пао кленодар агро"
    known = frozenset(x[i : i + 4] for x in ("сполохдар",) for i in range(6))
    assert split_layout("cgjkj[lfh", known) == "сполохдар" and split_layout("coupon", known) == "coupon"
    assert F is not None


def test_short_long_and_reordered_names(spark):
    long = "Объединённая Северо Западная Нефтехимическая Приборостроительная Инвестиционная Промышленность и Судостроительная Верфь"
    five = "Первая Восточная Медная Горная Рубежка"
    aliases = spark.createDataFrame([("ПАО «ВТБ»", "ВТБ"), ("ПАО «МТС»", "MTSS"), ("ГК Верфь", long), ("АО Рубежка", five), ("АО Двор", "Двор"), ("ООО Двор", "Двор")], "issuer string, alias string")
    asked = {"BTБ": {"ПАО «ВТБ»"}, "МТС Ltd": {"ПАО «МТС»"}, "МТСС": {"ПАО «МТС»"}, long.replace("Нефте", "Нетфе"): {"ГК Верфь"}, long.replace("Верфь", "Верф").replace("Объеди", "Обеди"): {"ГК Верфь"}, "Рубежка Горная Медная Восточная Первая": {"АО Рубежка"}, "Горная Рубежка Медная Первая Восточня": {"АО Рубежка"}, "двор": {"АО Двор", "ООО Двор"}, "ВТК": set(), "к" * 9000: set()}
    df = spark.createDataFrame([("f", str(i), n) for i, n in enumerate(asked)], "tbl string, row_key string, name string")
    text = f"Вчера {long.replace('Нефте', 'Нетфе')} открыла книгу."
    tx = spark.createDataFrame([("p", "1", text)], "tbl string, row_key string, text string")
    for most in (100, 2):
        rows = link_fields(df, tx, aliases, most).collect()
        got = {n: {r["issuer"] for r in rows if r["tbl"] == "f" and r["row_key"] == str(i)} for i, n in enumerate(asked)}
        assert got == asked
        assert {r["ties"] for r in rows if "Двор" in r["issuer"]} == {2} and {r["ties"] for r in rows if "Двор" not in r["issuer"]} == {1}
        assert {(r["issuer"], r["listed"]) for r in rows if r["tbl"] == "p"} == {("ГК Верфь", False)}


def test_keys_meet_within_two_edits():
    import random

    rng = random.Random(8)
    for n in (8, 20, LONG - 2, LONG, LONG + 1, LONG + 9):
        for _ in range(60):
            a = [rng.choice("абвгд") for _ in range(n)]
            b = a[:]
            for _ in range(2):
                i = rng.randrange(len(b) - 1)
                rng.choice([lambda: b.pop(i), lambda: b.insert(i, "ж"), lambda: b.__setitem__(i, "ж"), lambda: b.__setitem__(slice(i, i + 2), [b[i + 1], b[i]])])()
            x, y = "".join(a), "".join(b)
            if edit_distance(x, y) <= 2:
                assert not set(keys_of(x, False)).isdisjoint(keys_of(y, True)), (x, y)
