"""Queries on parties, over customers and orders written out as lines, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import query
from ledgerloom.operators import parties
from ledgerloom.sources.tables import table

c = F.col
_ID = "CAST(c_custkey AS STRING)"
#: Lines of a customer's invoice head; some lack the organisation, the phone, the name or a plausible address.
_LINES = {
    1: f"CASE WHEN c_custkey % 3 = 0 THEN 'Организация: ЗАО \"Дуб ' || {_ID} || '\"' ELSE 'слова' END", 2: f"'Поставщик: ООО \"Ива ' || {_ID} || '\", 220001, г. Минск, ул. Новая, ' || {_ID}", 3: "CASE WHEN c_nationkey % 2 = 0 THEN 'тел. 123' ELSE 'УНП ' || CAST(190000000 + c_custkey AS STRING) END",
    4: f"CASE WHEN c_custkey % 4 = 0 THEN 'Покупатель: кто-то' ELSE 'Покупатель: УНП ' || CAST(200000000 + c_custkey AS STRING) || ', КПП ' || CAST(300000000 + c_custkey AS STRING) || ', ОАО «Лес ' || {_ID} || '»,' END", 5: f"CASE WHEN c_custkey % 5 = 0 THEN 'коротко' ELSE 'Беларусь, Брест, ул. Мира ' || {_ID} || ', тел. +375 29 1234567' END", 6: "'Основание: договор'",
}


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ЗАО "Дуб ' || CAST(c_custkey AS VARCHAR) || '"' ELSE 'ООО "Ива ' || CAST(c_custkey AS VARCHAR) || '"' END AS supplier, CASE WHEN c_custkey % 3 > 0 AND c_nationkey % 2 > 0 THEN CAST(190000000 + c_custkey AS VARCHAR) END AS supplier_tax,
 CASE WHEN c_custkey % 3 > 0 THEN '220001, г. Минск, ул. Новая, ' || CAST(c_custkey AS VARCHAR) END AS supplier_address, CASE WHEN c_custkey % 4 > 0 THEN 'ОАО «Лес ' || CAST(c_custkey AS VARCHAR) || '»' END AS customer, CASE WHEN c_custkey % 4 > 0 THEN CAST(200000000 + c_custkey AS VARCHAR) END AS customer_tax, CASE WHEN c_custkey % 4 > 0 THEN CAST(300000000 + c_custkey AS VARCHAR) END AS kpp,
 CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'кто-то ' ELSE '' END || 'Беларусь, Брест, ул. Мира ' || CAST(c_custkey AS VARCHAR) END AS customer_address, CASE WHEN c_custkey % 5 > 0 THEN '+375 29 1234567' END AS phone FROM customer""")
def invoice_parties(spark, root):
    each = F.array(*(F.struct(F.lit(n).alias("line_no"), F.expr(sql).alias("line")) for n, sql in _LINES.items()))
    lines = table(spark, root, "customer").select("c_custkey", F.inline(each))
    found = parties.invoice_parties(lines, "c_custkey")
    names = {"supplier": "supplier.name", "supplier_tax": "supplier.tax_id", "supplier_address": "supplier.address", "customer": "customer.name", "customer_tax": "customer.tax_id", "kpp": "customer.kpp", "customer_address": "customer.address", "phone": "customer.phone"}
    return found.select("c_custkey", *(c(v).alias(k) for k, v in names.items()))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS k, CAST(o_orderkey AS VARCHAR) AS id FROM orders), t AS (SELECT *, CASE k WHEN 0 THEN 'ООО «Ива ' || id || '»' WHEN 1 THEN 'г. Минск ул. Мира ' || id || ' кв. 5' WHEN 2 THEN '2-й экз. длинный текст без всякого смысла ' || id ELSE 'слово ' || id END AS text FROM r),
 s AS (SELECT *, length(text) + CASE k WHEN 0 THEN 100 WHEN 1 THEN 25 WHEN 2 THEN -500 ELSE -50 END AS score FROM t) SELECT o_custkey, text, score FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1""")
def best_party_texts(spark, root):
    spelt = "CASE o_orderkey % 4 WHEN 0 THEN 'ООО «Ива ' || CAST(o_orderkey AS STRING) || '»' WHEN 1 THEN 'г. Минск ул. Мира ' || CAST(o_orderkey AS STRING) || ' кв. 5' WHEN 2 THEN '2-й экз. длинный текст без всякого смысла ' || CAST(o_orderkey AS STRING) ELSE 'слово ' || CAST(o_orderkey AS STRING) END"
    readings = table(spark, root, "orders").selectExpr("o_custkey", "o_orderkey", f"{spelt} AS reading")
    return parties.best_party_text(readings, ["o_custkey"], "reading", "o_orderkey")
