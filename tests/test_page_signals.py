"""Signals of pages against a plain Python reading of the same text, and documents cut from text alone."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import page_signals, segments

PHRASES = [
    "Счет № 5-A", "счёт от 01.02.2024", "Счет-протокол", "СЧЕТ ПРОТОКОЛ согласования свободных цен", "Товарно-транспортная накладная", "товарная <b>накладная</b>", "Платежное поручение", "Продавец: Ива", "Покупатель: Дуб", "покупателя", "основание отпуска", "Грузоотправитель", "грузополучатель",
    "банк-отправитель", "Бенефициар", "назначение платежа", "сумма и валюта", "поставщик", "внимание", "специалист по работе", "счет действителен в течение 3 дней", "счет действителен до 5", "отпуск разрешил", "итого 5", "Всего", "всего к оплате", "директор", "дата исполнения", "подпись", "сумма прописью", "слово", "x", "12", "",
]


def has(text, *patterns):
    return any(re.search(p, text, re.I) for p in patterns)


def by_hand(p):
    top, mid, bottom, tail, full = (p[k] or "" for k in ("top", "mid", "bottom", "tail", "full"))
    every, head, end = " ".join(x for x in (top, mid, bottom, full) if x), f"{top} {full}", f"{tail} {full}"
    plain = re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", top)).strip()
    name = "ТОВАРНО-ТРАНСПОРТНАЯ НАКЛАДНАЯ" if has(plain, r"товарно[-\s]*транспортн\w*\s+накладн") else "ТОВАРНАЯ НАКЛАДНАЯ" if has(plain, r"товарн\w*\s+накладн") else None
    protocol, named, payment = has(top, r"счет[-\s]*протокол"), has(every, r"счет[-\s]*протокол"), has(top, r"платежн\w+\s+поручен")
    invoice = not protocol and (has(plain, r"\bсч[её]т\s*(?:№|N|No|#)\s*[A-Za-zА-Яа-я0-9\-/]+", r"\bсч[её]т\b.{0,30}\bот\b.{0,20}[0-3]?\d[./][01]?\d[./]20\d{2}") or has(plain, r"\bпродавец\s*:") and has(plain, r"\bпокупател(?:ь|я)\s*:"))
    count = lambda text, *ps: sum(has(text, x) for x in ps)
    s = {
        "invoice": 4 * invoice + count(head, r"\bпродавец\b", r"\bпокупател", r"\bоснован") + 2 * has(every, r"\bвнимание\b", r"специалист\s+по\s+работе", r"счет\s+действителен\s+в\s+течение") - 4 * named,
        "waybill": 6 * bool(name) + count(head, "грузоотправ", "грузополуч", r"основание\s+отпуска") + 2 * has(end, r"отпуск\s+разрешил", r"сдал\s+грузоотправитель", r"принял\s+грузополучатель"),
        "payment_order": 8 * payment + count(head, "банк-отправ", "бенефициар", r"назначение\s+платеж", r"сумма\s+и\s+валюта"),
        "account_prot": 8 * protocol + 5 * (named and not protocol) + count(head, r"\bпоставщик\b", r"\bпокупател") + 2 * has(every, r"согласования\s+свободных", r"при\s+получении\s+товара\s+необходимо", r"счет\s+действителен\s+до"),
    }
    kind = "payment_order" if payment else "waybill" if name else "account_prot" if protocol else max(s, key=s.get) if max(s.values()) > 0 else "unknown"
    title = payment or bool(name) or protocol or invoice
    low = f"{bottom} {tail}"
    words = {"invoice": r"\bитого\b|\bвсего\b|счет\s+действителен|внимание|специалист\s+по\s+работе|директор", "waybill": r"\bитого\b|\bвсего\b|отпуск\s+разрешил", "payment_order": r"дата\s+исполнения", "account_prot": r"\bитого\b|\bвсего\b|счет\s+действителен\s+до|сумма\s+прописью", "unknown": r"\bитого\b|\bвсего\b|подпись|директор"}
    sure = {"invoice": r"всего\s+к\s+оплате|директор", "account_prot": r"счет\s+действителен\s+до|сумма\s+прописью"}
    footer = has(low, words[kind]) or kind in sure and has(full, sure[kind])
    goes_on = p["table_top"] is not None and p["table_top"] <= 0.18 and not title
    found = re.findall("[A-Za-zА-Яа-яЁё0-9]{2,}", full)
    blank = (len(re.sub(r"\s", "", full)) < 25 or sum(map(len, found)) < 18 and len(found) <= 3) and not title and not footer
    if blank:
        role = "blank"
    elif kind == "payment_order":
        role = "single_candidate" if title else "unknown"
    elif title:
        role = "single_candidate" if footer and not goes_on else "first_candidate"
    elif footer:
        role = "last_candidate"
    else:
        role = "middle_candidate" if goes_on or p["page_no"] > 1 and p["layout"] == "table" else "unknown"
    text = " ".join(x for x in (name, top, full) if x)
    hard = None
    if has(text, r"счет[-\s]*протокол"):
        hard = "account_prot"
    elif has(text, r"платежн\w*\s+поручен"):
        hard = "payment_order"
    elif name or has(text, r"товарн(?:о[-\s]*транспортн\w*\s+)?накладн") or has(text, "грузоотправ") and has(text, "грузополуч") and has(text, r"основани[ея]\s+отпуска", r"отпуск\s+разрешил"):
        hard = "waybill"
    elif has(text, r"\bсчет\b\s*(?:№|N|No|#)\s*[\w#/\-]+", r"\bсчет\b.{0,30}\bот\b.{0,24}(?:[0-3]?\d[./][01]?\d[./]20\d{2}|[0-3]?\d\s+\w+\s+20\d{2})") and (has(text, r"\bпокупател") and has(text, r"\bпродавец\b", r"\bпоставщик\b") or has(text, r"\bоснован")):
        hard = "invoice"
    return kind, name, s, title, footer, goes_on, blank, role, hard


def test_signals(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(PHRASES) for _ in range(rng.randrange(n))) if rng.random() < 0.95 else None
    pages = [{"source_id": "s", "page_no": rng.randrange(1, 4), "page_id": str(i), "top": some(3), "mid": some(3), "bottom": some(3), "tail": some(4), "full": some(6), "table_top": rng.choice([None, 0.1, 0.18, 0.5]), "layout": rng.choice([None, "table", "form"])} for i in range(3000)]
    df = spark.createDataFrame(pages, "source_id string, page_no int, page_id string, top string, mid string, bottom string, tail string, full string, table_top double, layout string").repartition(3)
    out = page_signals.signals(df)
    got = {r.page_id: (r.page_doc_type, r.document_name, dict(r.scores), r.has_title, r.has_footer, r.continuation_like, r.blank, r.role_hint, r.hard_type) for r in out.collect()}
    for p in pages:
        assert got[p["page_id"]] == by_hand(p), p
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and len({x[0] for x in got.values()}) == 5
    kept = {r.page_id: (r.parser, r.route_error) for r in page_signals.routed(out).collect()}
    for i, x in got.items():
        want = x[0] if x[0] != "unknown" else x[8]
        assert kept[i] == (want, None if want else "no parser for unknown")
    assert {r.page_doc_type for r in page_signals.signals(df, "invoice").collect()} == {"invoice"}
    assert page_signals.signals(df.limit(0)).count() == 0


def test_documents_from_text_alone(spark):
    cell = lambda y, t: (0, y, 10, y + 10, t)
    pages = [
        ("a", 1, [cell(0, "Товарная накладная"), cell(50, "Грузоотправитель Ива, грузополучатель Дуб и многое другое на этой странице")], 100), ("a", 2, [cell(50, "строки таблицы, которые продолжаются дальше без конца и края"), cell(90, "Всего отпуск разрешил")], 100),
        ("a", 3, [cell(5, "Платежное поручение № 7 с длинным текстом назначения платежа")], 100), ("a", 4, [], 100), ("a", 5, [cell(1, "Счет № 5 от 01.02.2024 Продавец: Ива Покупатель: Дуб основание договор"), cell(95, "итого 5")], 100),
    ]
    df = spark.createDataFrame(pages, "source_id string, page_no int, cells array<struct<x1:int,y1:int,x2:int,y2:int,text:string>>, height int")
    df = df.withColumns({"page_id": F.concat("source_id", F.lit("__p"), F.col("page_no").cast("string")), "full": F.array_join(F.transform("cells", lambda x: x["text"]), " ")})
    seen = page_signals.signals(page_signals.zones(df))
    found = segments.segments(seen)
    assert {r.page_no: r.segment_no for r in found.collect()} == {1: 1, 2: 1, 3: 2, 5: 3}
    assert {r.segment_no: r.doc_type for r in segments.segment_types(found, seen).collect()} == {1: "waybill", 2: "payment_order", 3: "invoice"}
    roles = spark.range(1).select(page_signals.ready_role_hint(F.lit(False), F.lit(True), F.lit(True), F.lit(False)), page_signals.ready_footer(F.lit(False), F.lit("подпись")), page_signals.ready_footer(F.lit(False), F.lit("x"))).first()
    assert tuple(roles) == ("single_candidate", True, False)
