"""Parties, expected values by hand."""

from pyspark.sql import functions as F

from ledgerloom.operators import parties


def lines_of(spark, docs):
    return spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc string, line_no int, line string").repartition(3)


def test_sections(spark):
    docs = {"a": ["x Начало: здесь", "Начало: один", "два", None, "конец: три", "Начало: снова"], "b": ["слова Начало: y", "z"], "c": ["ничего"], "d": ["Начало: сам конец:", "ещё"]}
    got = {r.doc: (r.s, r.t) for r in parties.sections(lines_of(spark, docs), "doc", {"s": ("Начало:", ("конец:",)), "t": ("конец:", ("Начало:",))}).collect()}
    assert got == {"a": ("Начало: один два", "конец: три"), "b": ("Начало: y z", None), "c": (None, None), "d": ("Начало: сам конец: ещё", "конец: ещё")}


def test_invoice_parties(spark):
    docs = {
        "a": ['Поставщик: ООО "Ромашка", 220001, г. Минск, ул. Ленина, д. 5', "тел. 123", "Покупатель: УНП 200000002, КПП 300000003, Общество с ограниченной ответственностью «Ива Плюс»,", "Беларусь, Брест, ул. Мира 7, тел. +375 29 123-45-67", "Основание: договор"],
        "b": ['Организация: ЗАО "Дуб"', "УНП 190000001", "Поставщик: г. Минск, ул. Новая, д. 1", "Покупатель: кто-то", "Счет № 5"], "c": ["слова"],
    }
    got = {r.doc: r for r in parties.invoice_parties(lines_of(spark, docs), "doc").collect()}
    assert tuple(got["a"].supplier) == ('ООО "Ромашка"', None, "220001, г. Минск, ул. Ленина, д. 5")
    assert tuple(got["a"].customer) == ("Общество с ограниченной ответственностью «Ива Плюс»", "200000002", "Беларусь, Брест, ул. Мира 7", "300000003", "+375 29 123-45-67")
    assert tuple(got["b"].supplier) == ('ЗАО "Дуб"', None, None) and tuple(got["b"].customer) == (None, None, None, None, None)
    assert got["c"].supplier is None and got["c"].customer is None


def test_waybill_parties(spark):
    rows = [
        ("(наименование) ООО «Ива» , г. Минск (адрес) ул. Мира", ("ООО «Ива»", "г. Минск ул. Мира"), False, True), ("Иванов, г. Минск", ("Иванов", "г. Минск"), True, False), ("ул. Мира 5", ("ул. Мира 5", None), True, False), ("Грузоотправитель УП Лес", ("Грузоотправитель УП Лес", None), False, True), ("", (None, None), False, False), (None, (None, None), False, False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    out = df.select("i", parties.name_and_address(F.col("t")).alias("n"), parties.address_only(F.col("t")).alias("a"), parties.anchor_noise(F.col("t")).alias("x"), parties.party_score(F.col("t")).alias("s"), parties.confident(F.col("t"), F.lit("г. Минск")).alias("k"))
    for r in out.collect():
        assert (tuple(r.n), r.a, r.x) == rows[r.i][1:], rows[r.i]
    scores = {r.i: (r.s, r.k) for r in out.collect()}
    assert scores[2] == (10 + 25, False) and scores[4] == scores[5] == (-10_000, False) and scores[3] == (23 + 100, True)
    best = parties.best_party_text(spark.createDataFrame([("a", 1, "ул. Мира 5"), ("a", 2, "ООО «Ива»"), ("a", 3, "УП «Дуб»"), ("b", 1, None)], "doc string, n int, t string"), ["doc"], "t", "n")
    assert {r.doc: (r.text, r.score) for r in best.collect()} == {"a": ("ООО «Ива»", 59), "b": (None, -10_000)}
    people = spark.createDataFrame([("директор Иванов И.И. склад 5",), ("склад",), (None,)], "t string").select(parties.person_and_rest(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in people] == [("директор Иванов И.И.", "склад 5"), ("склад", None), (None, None)]
