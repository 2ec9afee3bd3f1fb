"""Words for amounts, repaired text, parsers, pages to documents, nested documents and files."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money_words, text
from ledgerloom.operators import documents, nested, segments
from ledgerloom.sources import tables
from ledgerloom.streaming import jobs


def test_amounts_in_words(spark):
    known = {
        0.0: "Ноль руб. 00 коп", 1.05: "Один руб. 05 коп", 2312.4: "Две тысячи триста двенадцать руб. 40 коп", 21000.0: "Двадцать одна тысяча руб. 00 коп",
        5_000_001.99: "Пять миллионов один руб. 99 коп", 1114.999: "Одна тысяча сто пятнадцать руб. 00 коп",
    }
    df = spark.createDataFrame([(a,) for a in (*known, -1.0, None, 1e12)], "a double")
    got = {r.a: r.w for r in df.select("a", money_words.money_in_words(F.col("a")).alias("w")).collect()}
    assert got == known | {-1.0: None, None: None, 1e12: None}
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(10 ** rng.randint(1, 13)) / 100,) for _ in range(2000)], "a double")
    words = df.withColumn("w", money_words.money_in_words(F.col("a")))
    assert words.filter(~F.coalesce(F.abs(money_words.words_to_money(F.col("w")) - F.col("a")) < 0.011, F.lit(False))).count() == 0
    assert words.filter(money_words.needs_rebuild(F.lower("w"), F.col("a"))).count() == 0
    odd = spark.createDataFrame([("Всего: сто двадцать белорусских рублей 7 коп.",), ("без слов",), (None,), ("тысяча рублей",)], "t string")
    assert [r[0] for r in odd.select(money_words.words_to_money(F.col("t"))).collect()] == [120.07, None, None, 1000.0]


def reread(value):
    marks = ("Р", "С", "вЂ", "в„", "Ð", "Ñ")
    tries = [value]
    for _ in range(2):
        try:
            tries.append(tries[-1].encode("cp1251").decode("utf-8"))
        except UnicodeError:
            break
    return min(tries, key=lambda v: 5 * v.count("�") + sum(v.count(m) for m in marks))


def test_broken_encoding(spark):
    once = "Всего к оплате — №5".encode().decode("cp1251", "replace")
    cases = ["", "plain", "Ведомость", "Накладная", once, "Товар".encode().decode("cp1251"), "Товар".encode().decode("cp1251").encode().decode("cp1251"), "Счет Р", "naïve ç 中"]
    rows = spark.createDataFrame([(c,) for c in [*cases, None]], "t string").select("t", text.repair_encoding(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [*map(reread, cases), None]


def test_fields_in_text(spark):
    row = spark.range(1).select(
        text.account_number(F.lit("счет ВY 13 NBRB 3600 9000 0000 2Z00 AB00 (осн)")).alias("account"), text.bank_codes(F.lit("код AKBBBY2X и AKBBBY2X, NBRBBY2XXXX")).alias("banks"),
        text.tax_ids(F.lit("УНП 123456789, 1234567890, 987654321 и 123456789")).alias("tax"), text.between(F.lit("Покупатель: ООО  Ромашка\nАдрес: Минск"), "покупатель:", ["адрес", "унп"]).alias("party"),
        text.page_stem(F.lit("a__p0012")).alias("stem"), text.page_number(F.lit("a__p0012")).alias("page"), text.split_cells(F.lit("a | b|c ")).alias("cells"), text.size_text(F.lit(1536)).alias("size"),
        text.trim_edge_noise(F.lit("-- | Болт М8 ..")).alias("edge"), text.clean_or_review(F.lit("a  b"), F.lit(False), "!").alias("clean"), text.clean_or_review(F.lit("x"), F.lit(True), "!").alias("marked"),
    ).first()
    assert row.account == "BY13NBRB3600900000002Z00AB00" and row.banks == ["AKBBBY2X", "NBRBBY2XXXX"] and row.tax == ["123456789", "987654321"]
    assert (row.party, row.stem, row.page, row["cells"], row.size) == ("ООО Ромашка", "a", 12, ["a", "b", "c"], "1.5 KB")
    assert (row.edge, row.clean, row.marked) == ("Болт М8", "a b", "!")


def rows(spark, cells):
    return spark.createDataFrame([("d", 1, k, c) for k, c in enumerate(cells)], "document_id string, page_no int, row_no int, cells array<string>")


def test_waybill_rows(spark):
    got = documents.waybill_items(rows(spark, [
        ["Наименование товара", *["x"] * 8], ["1", "2", "3", "4", "5", "6", "7", "8", "9"], ["Болт", "шт.", "1O", "2,50", "25.00", "20 %", "5,00", "30,00 руб", ""],
        ["Итого", *["1"] * 8], ["Гайка", "кг"], ["77", *["1"] * 8], [None] * 9,
    ])).collect()
    assert [tuple(r)[3:] for r in got] == [("Болт", "шт", 10, 2.5, 25.0, "20%", 5.0, 30.0, None)]


def test_invoice_and_account_rows(spark):
    got = documents.invoice_items(rows(spark, [
        ["7", "A-1", "Болт", "4810000000017", "3", "шт", "1,2", "3,6", "0", "3", "20", "0,6", "3,6"], ["?", "A-2", "Гайка", None, "1", "шт", "2", "2", "0", "1,67", "20%"],
        ["", "1", "2", "3", "4", "5", "6", "7", "8", "9"], ["Итого", "a", "b", "", "1", "2", "3", "4", "5", "6"], ["1", "a"],
    ])).orderBy("row_no").collect()
    assert [(r.line_number, r.article, r.quantity, r.vat_rate, r.total_with_disc_incl_vat) for r in got] == [(7, "A-1", 3, "20%", 3.6), (8, "A-2", 1, "20%", None)]
    table = rows(spark, [["4810000000017 Молоко", "шт", "", "1", "0", "1", "10", "10%", "1", "11"], ["Итого:", "", "", "", "", "", "10", "", "1", "11"], ["короткая"]])
    item = documents.account_items(table).first()
    assert (item.line_number, item.sku, item.description, item.quantity, item.total_incl_vat) == (1, "4810000000017", "Молоко", 1, 11.0)
    assert tuple(documents.account_totals(table).first()) == ("d", 10.0, 1.0, 11.0)


def test_payment_order(spark):
    full = "ПЛАТЕЖНОЕ ПОРУЧЕНИЕ № 125 (электронное) Дата: 5.03.2024 Срочный Несрочный Х Сумма и валюта: 1 250,50 BYN Счет № BY13NBRB3600900000002Z00AB00 Счет № BY14NBRB3600900000002Z00AB01 Код валюты: 933 Назначение платежа: оплата по счету 7 № документа: 1 Дата исполнения: 06.03.2024 10:15"
    p = spark.createDataFrame([(full,), (None,)], "t string").select(documents.payment_order(F.col("t")).alias("p")).select("p.*").collect()
    assert tuple(p[0]) == ("125", "электронное", "05.03.2024", False, True, 1250.5, "933", "BY13NBRB3600900000002Z00AB00", "BY14NBRB3600900000002Z00AB01", "оплата по счету 7", None, "06.03.2024 10:15")
    assert p[1].payment_order_number is None and p[1].urgent is False


def test_merging_pages(spark):
    items = spark.createDataFrame([("d", 1, 1, "Болт", 2.0), ("d", 2, 1, " болт", 2.0), ("d", 2, 2, "Гайка", None)], "document_id string, page_no int, row_no int, name string, quantity double")
    assert sorted(r.name for r in documents.distinct_items(items).collect()) == ["Болт", "Гайка"]
    pages = spark.createDataFrame([("d", 2, "b", 2), ("d", 1, " ", None), ("d", 3, "c", 3)], "document_id string, page_no int, number string, n int")
    assert tuple(documents.merge_headers(pages, ["number", "n"]).first()) == ("d", "b", 2)


PAGES = "source_id string, page_no int, page_id string, blank boolean, has_title boolean, has_footer boolean, continuation_like boolean, role_hint string, page_doc_type string, hard_type string, scores map<string,int>"


def vote(pages):
    first = {p[9] for p in pages if p[9] and p[7] in ("single_candidate", "first_candidate")}
    if first:
        return first.pop() if len(first) == 1 else None
    hard = [p[9] for p in pages if p[9]]
    if hard:
        best = max(map(hard.count, hard))
        top = {h for h in hard if hard.count(h) == best}
        return top.pop() if len(top) == 1 else None
    sums = {t: sum((p[10] or {}).get(t, 0) for p in pages) for t in segments.TYPES}
    best = max(segments.TYPES, key=sums.get)
    return best if sums[best] > 0 else None


def test_pages_to_documents(spark):
    rng = random.Random(11)
    pick = lambda *x: rng.choice(x)
    data = [(f"s{s}", n, f"s{s}__p{n}", rng.random() < 0.1, pick(True, False), pick(True, False), pick(True, False, False), pick("single_candidate", "first_candidate", "last_candidate", "middle", None), pick("unknown", *segments.TYPES, None), pick(None, None, *segments.TYPES), pick(None, {t: rng.randint(0, 3) for t in segments.TYPES})) for s in range(12) for n in range(1, 25) if rng.random() > 0.1]
    want, kinds = {}, {}
    for source in {p[0] for p in data}:
        docs: list[list] = []
        for p in sorted((p for p in data if p[0] == source and not p[3]), key=lambda p: p[1]):
            if docs:
                prev = docs[-1][-1]
                strong, closed, before = p[4] and not p[6], prev[5] or prev[7] in ("single_candidate", "last_candidate"), vote(docs[-1])
                new = p[1] != prev[1] + 1 or (p[8] == "payment_order" and strong) or (strong and closed and (bool(before and p[8] and p[8] not in ("unknown", before)) or prev[5]))
            if not docs or new:
                docs.append([])
            docs[-1].append(p)
        want |= {p[2]: k for k, d in enumerate(docs, 1) for p in d}
        kinds |= {(source, k): vote(d) or "unknown" for k, d in enumerate(docs, 1)}
    df = spark.createDataFrame(data, PAGES)
    found = segments.with_roles(segments.segments(df))
    assert {r.page_id: r.segment_no for r in found.collect()} == want
    assert {(r.source_id, r.segment_no): r.doc_type for r in segments.segment_types(found, df).collect()} == kinds
    assert segments.segments(df.limit(0)).count() == 0


def test_page_type_and_blank(spark):
    scores = {t: F.lit(n) for t, n in zip(segments.TYPES, (1, 2, 2, 0))}
    no, yes = F.lit(False), F.lit(True)
    row = spark.range(1).select(segments.page_type(scores, no, no, no), segments.page_type(scores, no, no, yes), segments.page_type({t: F.lit(0) for t in scores}, no, no, no), segments.blank_page(F.lit("a b"), no, no), segments.blank_page(F.lit("a b"), yes, no), segments.blank_page(F.lit(None).cast("string"), no, no)).first()
    assert tuple(row) == ("waybill", "account_prot", "unknown", True, False, True)


def test_nested_documents(spark):
    doc = {"a": {"b": [{"c": 1}, {"c": None}], "e": [], "f": {}}, "g": "x", "h": True}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "{"), (4, "{}")], "k int, j string")
    found = nested.flatten(df, "k", "j").withColumn("general", nested.general_path(F.col("path")))
    assert sorted(tuple(r) for r in found.collect() if r.value) == [(1, "a.b[0].c", "1", "a.b[*].c"), (1, "a.e", "[]", "a.e"), (1, "g", "x", "g"), (1, "h", "true", "h")]
    assert found.count() == 5
    states = found.withColumn("state", text.field_state(F.col("value"), "!"))
    assert tuple(nested.document_counters(states, "k", "state").first()) == (1, 5, 1, 0, 0, False)


def test_files(spark, tmp_path):
    root = tmp_path / "run"
    (root / "stage1").mkdir(parents=True)
    (root / "stage1/a.txt").write_text("й" * 100_001, encoding="utf-8")
    (root / "stage1/b.png").write_bytes(b"\x89PNG")
    pages = [{"page_id": "a__p0001", "text": "x", "ocr_items": [{"text": "x", "bbox": [1, 2, 3, 4]}]}]
    with zipfile.ZipFile(root / "all.zip", "w") as z:
        z.writestr("aggregate.json", json.dumps(pages))
        z.writestr("a__p0001__ocr_raw.json", json.dumps({"page_id": "other"}))
    assert {(r.path, r.stage, r.kind) for r in tables.artefacts(spark, str(root)).collect()} == {("stage1/a.txt", "stage1", "text"), ("stage1/b.png", "stage1", "image"), ("all.zip", "all.zip", "unknown")}
    shown = tables.artefact_text(spark, str(root)).collect()
    assert [(len(r.text), r.truncated) for r in shown] == [(100_000, True)]
    assert [(r.page_id, r.ocr_items[0].bbox) for r in tables.archived_pages(spark, str(root)).collect()] == [("a__p0001", [1, 2, 3, 4])]
    finals = spark.createDataFrame([("d", "a.json"), ("d", "d.json"), ("e", "z.json"), ("e", "b.json")], "document_id string, name string")
    assert {tuple(r) for r in tables.chosen_final(finals).collect()} == {("d", "d.json"), ("e", "b.json")}


def test_job_stream(spark, tmp_path):
    source, out = tmp_path / "events", str(tmp_path / "states")
    events = [("j1", "2024-01-01 00:00:00", "uploaded"), ("j1", "2024-01-01 00:00:05", "processing"), ("j2", "2024-01-01 00:00:01", "uploaded")]
    schema = "job string, ts timestamp, state string"
    for k, part in enumerate((events[:2], events[2:], [("j1", "2024-01-01 00:01:00", "failed")])):
        spark.createDataFrame(part, "job string, ts string, state string").selectExpr("job", "cast(ts as timestamp) as ts", "state").write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = jobs.write_states(stream, "job", "ts", "state", out, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert {(r.job, r.state, r.attempts) for r in jobs.latest_states(spark, out, "job").collect()} == {("j1", "failed", 1), ("j2", "uploaded", 0)}
    failed = spark.createDataFrame([("a", "failed", 0, 5), ("b", "failed", 2, None), ("c", "completed", 0, 3)], "job string, state string, attempts int, max_attempts int")
    assert {tuple(r)[:3] for r in jobs.next_attempts(failed).collect()} == {("a", "uploaded", 1), ("b", "failed", 3)}


def test_index_row_cleans_cells_once(spark):
    df = spark.createDataFrame([(["1", " 2", None, "l", "4"],), (["1", "", "2", "3"],), (["1", "2"],), (["1", "2", "4"],), (["а", "2", "3"],), ([],)], "cells array<string>")
    got = df.select(documents.index_row().alias("x"))
    assert [r.x for r in got.collect()] == [False, True, False, False, False, False]
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 2


def test_waybill_items_are_compiled(spark):
    """A soft number computes its digits once: the method of the items was longer than the JVM takes."""
    from ledgerloom import catalog
    from ledgerloom.functions.numbers import soft_number

    texts = {"12": 12, "-3,50": -3.5, "1 2O5": 1205, "1.234.50": 1234.5, "1,2,3": 12.3, "1,234.50": None, "<b>7</b> руб": 7, "": None, "-": None, "5\n": 5}
    df = spark.createDataFrame([(t, None if w is None else float(w)) for t, w in texts.items()], "t string, w double").withColumn("x", soft_number(F.col("t")))
    assert {r.t: r.x for r in df.collect()} == {r.t: r.w for r in df.collect()}
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 5
    every = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq
    codes = every(catalog.QUERIES["waybill_item_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    assert codes.size() and all(0 < codes.apply(k)._3().maxMethodCodeSize() < 8000 for k in range(codes.size()))
