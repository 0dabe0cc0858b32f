import pytest

from quern.llm.pii import SkipChainCRF, candidates, find_mentions, fit_on, redact, redact_texts

CASES = {
    "Договор подписал Мохначов Вадим Артёмович.": ["person_name"],
    "Спор ведут Igor Mokhnachov и Т.Г. Чернолозова": ["person_name"] * 2,
    "Контакт: Peplogorova, U., +7 (948) 148-49-11": ["person_name", "phone"],
    "Передайте документы Борису Снегоярину": ["person_name"],
    "ПАВЕЛ ТИМУРОВИЧ КРУТОЯРЦЕВ СНИЛС: 909 158 393 35": ["person_name", "id_number"],
    "Пишите на v.ivanov @ list.invalid или a[собака]b[точка]example, mailto:x.y+z@corp.test": ["email"] * 3,
    "паспорт серия 8318 номер 910375; ИНН: 9954 794140 76; снилс 90586576247": ["id_number"] * 3,
    "Курьер приедет: 369911, г. Тихоплёс, ул Кедровая д.97 кв.251, тел. 7.974.195.75.58": ["address", "phone"],
    "медовая улица 10, квартира 122; пр-т Геологов 59к2, кв 13; 116 Quarry Road, Apt 37": ["address"] * 3,
    "Звонить +44 20 7946 0673 или 8-944-817-86-24": ["phone"] * 2,
    "ИНН эмитента 9986904090, оборот 8 227 607 880 руб., проспект эмиссии опубликован 15 августа": [],
    "заявка ушла 4817@11,43, писал @bondkot31, а на улице у офиса ни души, в городе Тихоплёс": [],
    "ОРИЕНТИР НИЖЕ НА 490 Б.П. ЛИЗИНГОДАТЕЛЬ выпуск 4B02-39-65888-A-004P. Народ": [],
    "Сполохдар Фарм и ПАО «Жемчугоключ» https://bonds.example/7065 тихий.волк77": [],
    "": [], "к" * 50_000: [],
}


@pytest.fixture(scope="module")
def model():
    return SkipChainCRF().fit([candidates(t) for t in CASES])


@pytest.mark.parametrize("text", list(CASES))
def test_mentions(model, text):
    assert [k for _, _, k, _ in model.mentions(text)] == CASES[text]


def test_redaction_keeps_the_rest(model):
    text = "Контакт: Фёдор Мшистовцев, 8-944-363-11-37; почта p.r@corp.test!"
    assert redact(text, model.mentions(text)) == "Контакт: [PERSON_NAME], [PHONE]; почта [EMAIL]!"
    plain = "Купон 9,79% и больше ничего"
    assert redact(plain, model.mentions(plain)) == plain and redact(None, []) is None


def test_skip_factors_carry_labels():
    m = SkipChainCRF(skip=3.0, chain=0.0)
    text = "Звонил Туманоброд А.Б. и снова. " + "слово " * 30 + "Договор подписал Туманоброд Кира Вадимовна"
    cs = candidates(text)
    assert len(cs) == 2 and cs[0].keys & cs[1].keys
    alone = SkipChainCRF(skip=0.0, chain=0.0).marginals(cs)
    assert m.marginals(cs)[0] > alone[0]
    assert m.marginals(cs[:1])[0] == pytest.approx(alone[0])


def test_tables(spark):
    rows = [("m", str(i), t, 1) for i, t in enumerate(CASES)] + [("m", "null", None, 1), ("m", "0", next(iter(CASES)), 1)]
    df = spark.createDataFrame(rows, "tbl string, row_key string, text string, kind int")
    model = fit_on(df)
    found = find_mentions(df, model).select("tbl", "row_key", "kind", "nth").distinct()
    assert found.count() == sum(map(len, CASES.values()))
    assert redact_texts(df, model).count() == len(rows)
    empty = df.limit(0)
    assert find_mentions(empty, fit_on(empty)).count() == 0 and redact_texts(empty, model).count() == 0


#: A bare surname is told by its distant mates only: the first text names it with a title or in full, the others don't.
MATES = [
    ("Решение принял директор Вольнозерцев. " + "Дальше обсуждали купон и сроки. " * 4 + "Затем слово взял Вольнозерцев и ушёл.", 2),
    ("Договор подписал Мохначов Вадим Артёмович. " + "Торги шли как обычно. " * 5 + "Вечером туда пришёл Мохначов один.", 1),
    ("Вопрос задал г-н Перекатов. " + "Рынок молчал. " * 6 + "Потом на это сослался Перекатов ещё раз, и снова ответил Перекатов коротко.", 3),
]


@pytest.mark.parametrize(("text", "bare"), MATES)
def test_bare_surnames_follow_their_mates(text, bare):
    model = SkipChainCRF().fit([candidates(t, True) for t in CASES])
    got = [k for _, _, k, _ in model.mentions(text)]
    assert got.count("surname") == bare
    off = SkipChainCRF(model.weights, model.chain, 0.0)
    assert [k for _, _, k, _ in off.mentions(text)].count("surname") < bare
    assert "[PERSON_NAME]" in redact(text, model.mentions(text))


def test_bare_words_without_mates_are_nothing(model):
    for text in ("Вчера вышел Вольнозерцев и ушёл.", "Группа «Вольнозерцев» и ПАО «Мохначов» разместили бумаги.", "Выпуск Рост Доходов закрыт, Совет Директоров молчит."):
        assert model.mentions(text) == []


def test_names_that_are_not_listed(model):
    for text in ("Звонил г-н Ахмед Мамедов по вопросу", "Отвечает менеджер Гульнара Ибрагимова завтра", "A note by Mr John Smith on bonds", "Auteur: Jean Dupont"):
        assert [k for _, _, k, _ in model.mentions(text)] == ["person_name"], text


def test_factors_are_learned():
    full = "Договор подписал Мохначов Вадим Артёмович. Вечером пришёл Мохначов один."
    org = "Спорят «Вольнозерцев Групп» и банк, а рядом ООО Вольнозерцев Трейд."
    model = SkipChainCRF().fit([candidates(t, True) for t in [full, org] * 10])
    assert model.skip != SkipChainCRF().skip and model.skip > 0 and model.chain >= 0
    assert SkipChainCRF(chain=0.0, skip=0.0).fit([candidates(full, True)] * 5).skip == 0
    hard = [c for c in candidates("ИНН эмитента 9986904090, сумма 8 227 607 880 руб.", True)]
    assert hard and all(c.sure == 0 for c in hard) and not candidates("ИНН эмитента 9986904090, сумма 8 227 607 880 руб.")


@pytest.mark.parametrize(("text", "kind"), [("пл. Ленина, 5", "address"), ("12 Elm Rd", "address"), ("5 Mill Lane, unit 3", "address"), ("живёт на ул-Кедровая, д. 9", None), ("Dr. Smith", "surname"), ("Zhanna Petrova", "person_name"), ("bадим кузин", "person_name"), ("Тел: 8 944 817-86-24", "phone")])
def test_short_forms_reach_the_patterns(text, kind):
    assert (kind in [c.kind for c in candidates(text)]) if kind else True
