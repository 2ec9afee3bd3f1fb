"""Text that can't be relied on against plain Python, final documents by hand."""

import json
import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import text_noise
from ledgerloom.operators import final_form, waybill_parts


def noisy(t):
    return bool(re.search(text_noise.BAD_SYMBOLS, t) or re.search("[?�]", t) or re.search("[Ͱ-Ͽ֐-׿؀-ۿ฀-๿₠-⃏←-⇿∀-⋿]", t))


def latin(t):
    return [w for w in re.findall("[A-Za-z]{3,}", t) if w.upper() not in set(text_noise.LATIN_WORDS)]


def mixed(t):
    out = []
    for token in re.split(r'[\s,;:()"/\\]+', t):
        x = token.strip(".,!?%№-_|")
        if re.search("[Ѐ-ӿ]", x) and re.search("[A-Za-z]", x):
            up = x.upper()
            if not (re.fullmatch(r"[A-Z]{2,}\.[Ѐ-ӿA-Z-]+", up) or re.fullmatch(r"[A-Z]{2,}-[Ѐ-ӿ-]+", x) or re.search(r"\bRU(?:\.\d+)+", up) or "SENSATION" in up or "ALPHA" in up):
                out.append(x)
    return out


def test_noise(spark):
    rng = random.Random(6)
    pieces = ["Крем", "крем-гель", "ESTEL", "shampoo", "unknown", "wordz", "Kрем", "ESTEL.крем", "PRO-крем", "RU.12Я", "Alphaы", "ї", "№", "..", ",,", ";;", "...", ", .", "α", "Ø", "?", "12", "abЖ", "xЖy", "-Жz.", "€", "→", "•"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 7))) for _ in range(1500)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    got = {r.i: r for r in df.select("i", text_noise.odd_signs(t).alias("o"), text_noise.unknown_latin(t).alias("l"), text_noise.mixed_tokens(t).alias("m"), text_noise.unreliable_item(t).alias("item"), text_noise.unreliable_strict(t).alias("strict")).collect()}
    for i, x in enumerate(texts):
        x = x or ""
        n, w, m, cyr = noisy(x), latin(x), mixed(x), bool(re.search("[Ѐ-ӿ]", x))
        other = bool(re.search(text_noise.OTHER_CYRILLIC, x))
        item = n or cyr and bool(re.search(r"\.{2,}|,{2,}|;{2,}|,\s*\.|\.\s*,", x)) and len(w) >= 2 or other and (len(w) >= 2 or len(m) >= 2) or len(m) >= 3 and len(w) >= 1
        strict = n or cyr and len(w) >= 2 or bool(re.search(r"\.{3,}|,{2,}|;{2,}", x)) and len(w) >= 1
        assert (got[i].o, got[i].l, got[i].m, got[i].item, got[i].strict) == (n, w, m, item, strict), x


def test_final_documents(spark):
    schema = "id int, kind string, file string, doc struct<number:string,_raw:string,items:array<struct<name:string,_x:int,price:double>>,more:struct<_a:int,b:map<string,string>>>"
    doc = ("5", "secret", [("a", 1, 2.5), ("b", None, None)], (1, {"k": "v", "_h": "w"}))
    rows = [(1, "invoice", 'f "1".pdf', doc), (2, "waybill", None, doc), (3, "invoice", " ", doc), (4, "letter", "f", doc), (5, None, "f", doc), (6, "waybill", "f", None), (7, "payment_order", "f", (None, None, None, None))]
    got = {r.id: (r.final and json.loads(r.final), r.shape_error) for r in final_form.final_json(spark.createDataFrame(rows, schema), "doc", "kind", "file").collect()}
    plain = {"number": "5", "items": [{"name": "a", "price": 2.5}, {"name": "b", "price": None}], "more": {"b": {"k": "v"}}}
    assert got[1] == ({"invoice": {'f "1".pdf': plain}}, None) and got[2] == (plain, None)
    assert [got[i] for i in (3, 4, 5, 6)] == [(None, "no file named"), (None, "unknown type letter"), (None, "unknown type (none)"), (None, "no document")]
    assert got[7][0] == {"payment_order": {"f": {"number": None, "items": None, "more": None}}}


def test_rows_without_an_item(spark):
    whole, none = (1.0, 2.0, 2.0, 20.0, 0.4, 2.4), (None,) * 6
    rows = [("Крем", "шт", None, *whole, False), ("Итого по листу", None, None, *whole, True), ("ИТОТА", None, None, *none, True), ("Издательство", "шт", None, *whole, True), ("LOREM IPSUM", None, "DOLOR", *none, True), ("LOREM IPSUM 5", None, "DOLOR", *none, False), ("ABCD", None, None, *none, True), ("ABCD", "шт", None, *none, False), ("ООО Ива", None, None, None, None, 5.0, None, None, None, True), ("ООО Ива", "шт", None, None, None, 5.0, None, None, None, False), (None, None, None, *none, False)]
    df = spark.createDataFrame(rows, "name string, unit string, note string, quantity double, price double, cost double, vat_rate double, vat_amount double, cost_with_vat double, want boolean")
    known = {f: F.col(f) for f in ("quantity", "price", "cost", "vat_rate", "vat_amount", "cost_with_vat")}
    for r in df.withColumn("got", waybill_parts.no_item_row(F.col("name"), F.col("unit"), F.col("note"), known)).collect():
        assert r.got == r.want, r
