"""Parts of waybills, expected values by hand."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog, catalog_waybills  # noqa: F401  (adds to the first)
from ledgerloom.operators import waybill_parts as parts


def taxes_by_hand(cells):
    widths = sorted(max(1, x2 - x1) for x1, _, x2, _, _ in cells)
    tol = max(40, int(widths[len(widths) // 2] * 0.35))
    xs = sorted((x1 + x2) / 2 for x1, _, x2, _, _ in cells)
    groups = [[xs[0]]]
    for x in xs[1:]:
        if x - groups[-1][-1] <= tol:
            groups[-1].append(x)
        else:
            groups.append([x])
    means, columns = [sum(g) / len(g) for g in groups], {}
    for x1, y1, x2, y2, t in cells:
        columns.setdefault(min(range(len(means)), key=lambda i: abs((x1 + x2) / 2 - means[i])), []).append(((y1 + y2) / 2, x1, t))
    out = {}
    for k, held in columns.items():
        held.sort(key=lambda h: (h[0], h[1]))
        tax = lambda t: (re.search(r"(?<!\d)(\d{9})(?!\d)", t or "") or [None, None])[1]
        out[k] = next((tax(t) for *_, t in held if tax(t)), None) or tax(" ".join(t for *_, t in held if t))
    return out


def test_tax_columns(spark):
    rng = random.Random(2)
    pages = {p: [(x := rng.randrange(3) * 200 + rng.randrange(60), y := rng.randrange(100), x + rng.choice([80, 100, 200]), y + 10, rng.choice([None, "УНП 190000001", f"{rng.randrange(10**8, 10**9)}", "12345", "1234567890", "слово"])) for _ in range(rng.randrange(1, 9))] for p in range(150)}
    df = spark.createDataFrame([(p, *(float(v) for v in s[:4]), s[4]) for p, cells in pages.items() for s in cells], "page_id int, x1 double, y1 double, x2 double, y2 double, text string").repartition(3)
    got = {}
    for r in parts.tax_columns(df).collect():
        got.setdefault(r.page_id, {})[r.place] = r.tax_id
    assert got == {p: taxes_by_hand(cells) for p, cells in pages.items()}
    three = {p: t for p, t in got.items() if len(t) == 3}
    for r in parts.party_taxes(df).collect():
        t = got[r.page_id]
        want = (t.get(0), t.get(1), t.get(2)) if len(t) > 2 else (t.get(0), None, t.get(1))
        assert (r.sender, r.payer, r.receiver) == want
    assert three and parts.party_taxes(df.limit(0)).count() == 0


def test_party_taxes_of_large_keys(spark, tmp_path):
    """Part numbers from 900,000 on make tax numbers of ten digits: the query's rows are still those of its SQL."""
    table, root = "lineitem.parquet", "/root/testdata/sf0.001"
    spark.read.parquet(f"{root}/{table}").withColumn("l_partkey", F.col("l_partkey") + 1_000_000).write.parquet(f"{tmp_path}/{table}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{table}/*.parquet'")
    got = catalog.QUERIES["party_taxes"](spark, str(tmp_path))
    want = con.execute(catalog.ORACLE_SQL["party_taxes"]).fetchall()
    assert sorted(map(str, map(tuple, got.select("page_id", "sender", "payer", "receiver").collect()))) == sorted(map(str, want)) and any(len(r[1] or "") > 9 for r in want)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Итого 12 100,00 20,00 120,00 Всего сумма НДС двадцать", (12, 100, 20, 120)), ("Итого x 5 1 234,50 200,00 1 434,50 Всего стоимость с НДС", (5, 1234.5, 200, 1434.5)), ("ИТОГО 20,00 120,00 всего сумма ндс", (2, 100, 20, 120)), ("Итого 7 5,00 20,00 120,00 Всего сумма НДС", (7, 100, 20, 120)),
        ("100,00 20,00 120,00 Всего сумма НДС", (None, None, None, None)), ("Итого 3 штуки Всего сумма НДС", (3, None, None, None)), ("Итого 100,00 20,00 120,00", None), ("", None), (None, None), ("Итого 9 1,00 1,00 Всего сумма НДС", (9, None, None, None)), ("Итого 4 " + "x" * 200 + " 5,00 6,00 Всего сумма НДС", (None, None, None, None)),
    ],
)
def test_footer_totals(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parts.footer_totals(F.col("t")).alias("f")).first().f
    assert (None if got is None else tuple(got)) == want


def test_settled_totals(spark):
    foot = "Итого 12 100,00 20,00 120,00 Всего сумма НДС"
    rows = [(1, 12.0, 100.0, 20.0, 120.0, foot), (2, 12.0, 500.0, 20.0, 120.0, foot), (3, None, 100.0, None, 120.0, foot), (4, 0.0, None, None, None, None), (5, 1.0, 5.0, 9.0, 3.0, "Итого 1 Всего сумма НДС")]
    df = spark.createDataFrame(rows, "id int, quantity_total double, cost_total double, vat_total double, cost_with_vat_total double, foot string")
    got = {r.id: (r.quantity_total, r.cost_total, r.vat_total, r.cost_with_vat_total, r.totals_from) for r in parts.settle_totals(df, "foot").collect()}
    whole = (12.0, 100.0, 20.0, 120.0)
    assert got == {1: (*whole, "items"), 2: (*whole, "text"), 3: (*whole, "both"), 4: (0.0, None, None, None, "items"), 5: (1.0, 5.0, 9.0, 3.0, "items")}


def test_addresses_and_required_fields(spark):
    rows = [("г. Минск Основание отпуска договор 5 С товаром переданы", None), ("г. Минск договор 7", "свой"), ("Договор 1", None), ("г. Минск", None), (None, "x"), ("а Основание отпуска С товаром", None)]
    df = spark.createDataFrame(rows, "a string, g string").select(parts.address_and_ground(F.col("a"), F.col("g")).alias("s"))
    assert [tuple(r.s) for r in df.collect()] == [("г. Минск", "Основание отпуска договор 5"), ("г. Минск", "свой"), ("Договор 1", "Договор 1"), ("г. Минск", None), (None, "x"), ("а", "Основание отпуска")]
    party = spark.createDataFrame([("Ива", None, " "), (None, None, None), (None, "а", "1")], "name string, address string, tax_id string")
    got = party.select(*(v.alias(k) for k, v in parts.required({n: F.col(n) for n in party.columns}).items())).collect()
    assert [tuple(r) for r in got] == [("Ива", parts.MARKER, parts.MARKER), (None, None, None), (None, "а", "1")]
    assert spark.range(1).select(parts.code_prefix(F.lit("OTHKBY22"))).first()[0] == "OTHRBY22"


def test_suspicious_items(spark):
    rows = [(1, "A10/16", "шт", "Крем", "20%", False), (1, "A10/16", "шт", "Крем", "19%", True), (12, "12A5/7", "шт", "Крем", "20%", True), (12, "125/7", "шт", "Крем", "20%", False), (1, None, "5,00", "Крем", None, True), (1, None, "1234567", "Крем", None, True), (1, None, None, "4810000000017", None, True), (1, None, "шт", "5 A10/16 Крем", "0%", True), (None, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "n int, a string, u string, d string, r string, want boolean")
    for r in df.withColumn("got", parts.suspicious_invoice_item(*(F.col(x) for x in "nau"), F.col("d"), F.col("r"))).collect():
        assert r.got == r.want, r
