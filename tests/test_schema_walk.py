"""Nested documents rewritten and merged; expected values by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalise
from ledgerloom.operators import schema_walk

M = normalise.MARKER
CASES = {
    "plain": [(" «Ромашка»  <b>плюс</b> , ", '"Ромашка" плюс'), ("а , б ; в", "а, б; в"), ("NaN", None), ("  ", None), (None, None)], "free": [("Текст Дата документа:", "Текст"), ("Дата документа: 5", "Дата документа: 5")],
    "address": [(", г. Минск, ул. Ленина 6a,", "г. Минск, ул. Ленина 6а"), ("дом 5 A", "дом 5а"), ("5ab", "5ab")], "bank_name": [("в банке ОАО Банк БИК AKBBBY2X", "ОАО Банк"), ("Банк AKBBBY2X г. Минск", "Банк г. Минск")],
    "party_name": [("Поставщик: ООО с ограниченно й о тветственностью", "ООО с ограниченной ответственностью"), ("Покупатель Ива", "Ива")], "unit": [("Шт.", "шт"), ("у п а к", "уп"), ("кг", "кг"), ("w", "шт"), ("коробка", "коробка"), (".", None)],
    "product": [("Крем. 200 мл. 4601234567890", "Крем, 200 мл, 4601234567890"), ("a ,b.", "a, b"), ("Т. 5 х", "Т. 5 х")], "money_words": [("сто 5руб 10 коп.", "сто 5 руб. 10 коп"), ("две копейк", "две копейки")],
    "number": [("1 234,50", 1234.5), ("O,5", 0.5), ("I2", 12.0), ("abc", None), ("12-", None), ("1.005", 1.0)], "whole": [("2,5", 2), ("3.5 шт", 4), ("нет", None)], "percent": [("20 %", "20%"), ("12,50", "12.5%"), ("без", "без"), (None, None), ("-5", "-5%")],
    "account": [("ВУ20 АКВВ О1", "BY20AKBB01")], "code": [("рсо b 12", "PCOB12")], "phone": [("+375 (29) 123-45-67", "+375291234567"), ("8 017 200", "8 017 200")], "email": [(" A@B.by ", "a@b.by")],
}


@pytest.mark.parametrize("name", CASES)
def test_forms(spark, name):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES[name])], "i int, t string")
    assert [r.v for r in df.select("i", getattr(normalise, name)(F.col("t")).alias("v")).orderBy("i").collect()] == [w for _, w in CASES[name]]


DOC = "key string, page int, doc struct<number:string,document_date:string,supplier:struct<name:string,bank:struct<account:string,bank_name:string>,phones:array<string>>,items:array<struct<name:string,quantity:string,price:string,vat_rate:string,parts:array<struct<code:string,amount:double>>>>,totals:struct<cost_total:string,urgent:string>>"


def test_documents_of_three_levels(spark):
    doc = ("№ 5 ", "1.2.2024", ("Поставщик: Ива", ("ВУ20 О", "в банке Б"), ["a", None]), [("Крем. 200 мл", "2,0", "1 0,5", "20", [("x", 1.0)]), ("Итого", "2", M, None, None), (None, M, None, M, [])], (M, "да"))
    rows = [("a", 1, doc), ("b", 1, (None, None, None, None, None)), ("c", 1, None)]
    df = schema_walk.normalise_documents(spark.createDataFrame(rows, DOC), "doc")
    got = {r.key: r for r in df.collect()}
    d = got["a"].doc
    assert (d.number, d.document_date, d.supplier.name, d.supplier.bank.account, d.supplier.bank.bank_name, d.supplier.phones) == ("№ 5", "01.02.2024", "Ива", "BY200", "Б", ["a", None])
    assert [(x.name, x.quantity, x.price, x.vat_rate, x.parts) for x in d["items"]] == [("Крем, 200 мл", 2, 10.5, "20%", [("x", 1.0)]), (None, None, None, None, [])]
    assert (d.totals.cost_total, d.totals.urgent) == (None, True)
    assert sorted(got["a"].doubts) == ["items[1].price", "items[2].quantity", "items[2].vat_rate", "totals.cost_total"]
    assert got["b"].doubts == [] and got["b"].doc == (None,) * 5 and got["c"].doc is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    wrapped = spark.createDataFrame([(((("x",),),),)], "doc struct<waybill:struct<inner:struct<a:string>>>")
    assert schema_walk.unwrap(wrapped, "doc").first().doc == ("x",)


def test_pages_merge_at_every_depth(spark):
    def page(key, n, number, name, account, items, cost, phones=None):
        return (key, n, (number, None, (name, (account, None), phones), items, (cost, "x" if cost else None)))

    a, b, c = ("Крем", "1", "2", "20", None), (" крем ", "1", "2", "20", None), ("Мыло", "1", "3", None, [])
    rows = [page("k", 2, "B", "Ива", "acc2", [b, c], "5"), page("k", 1, "  ", None, "acc1", [a, None], "4", ["", None]), page("k", 3, "C", "Дуб", None, None, None, ["p"]), page("one", 1, None, None, None, None, None), ("none", 1, None)]
    got = {r.key: r.doc for r in schema_walk.merge_pages(spark.createDataFrame(rows, DOC).repartition(3), "key", "page", "doc", tail=("totals",)).collect()}
    k = got["k"]
    assert (k.number, k.supplier.name, k.supplier.bank.account, k.supplier.phones, k.totals.cost_total) == ("B", "Ива", "acc1", ["p"], "4")
    assert [x.name for x in k["items"]] == ["Крем", "Мыло"]
    tail = schema_walk.merge_pages(spark.createDataFrame(rows[:2], DOC), "key", "page", "doc", tail=("totals",)).first().doc
    assert tail.totals.cost_total == "5" and tail.number == "B"
    assert got["one"] == (None,) * 5 and got["none"] == (None,) * 5
    assert schema_walk.merge_pages(spark.createDataFrame([], DOC), "key", "page", "doc").count() == 0


def test_values_are_read_once(spark):
    """A lambda computes what it refers to as often as it is written."""
    df = spark.createDataFrame([("Ш т.",), (" nan ",), ("",), (None,), (".",), ("Кг",)], "t string")
    got = df.select(F.transform(F.array("t"), normalise.unit)[0].alias("u"))
    assert [r.u for r in got.collect()] == ["шт", None, None, None, None, "кг"]
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 12
