"""Queries on item rows of cells, payment orders and boxes, over line items and orders written out as such, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import LINE, query
from ledgerloom.operators import boxes, documents
from ledgerloom.sources.tables import table

c = F.col
_LINE = ", ".join(LINE)
_ITEMS = f"SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS INT) AS rn FROM lineitem"


def _money(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * 100 + 0.5) / 100 AS DECIMAL(18, 2)) AS STRING)"


def _cents(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


_Q, _X = "CAST(CAST(l_quantity AS INT) AS STRING)", _money("l_extendedprice")
_P, _V, _T = _money("l_extendedprice / l_quantity"), _money("l_extendedprice * 0.2"), _money("l_extendedprice * 1.2")
_K = "(l_partkey % 7)"
#: Cells of invoice rows: items with and without a number, a row of totals, the head's numbering, too few cells, no figures.
_INVOICE = {0: ["CAST(rn * 2 AS STRING)", "'A/' || CAST(l_partkey AS STRING)", "'Краска'", "CAST(48100000 + l_partkey AS STRING)", _Q, "'шт'", _P, _X, "'0,50'", _X, "'20 %'", _V, _T], 3: ["'Итого'", "''", "''", "''", _Q, "''", _P, _X, "''", _X, "''", _V, _T], 4: [f"'{i}'" for i in range(1, 14)], 5: ["'1'", "'A'", "'x'", _Q, _P], 6: ["CAST(rn AS STRING)", "'A'", "'x'", "''", "'нет'", "'шт'", "''", "''", "''", "''", "''", "''", "''"]}
_INVOICE |= {1: ["'-'", *_INVOICE[0][1:]], 2: ["CAST(rn * 2 AS STRING) || '.'", *_INVOICE[0][1:10]]}
_ACCOUNT = {k: ["CAST(48100000 + l_partkey AS STRING) || '  Услуга'", "'шт'", _Q if k % 2 else "'0'", _P, "'1,00'", _P, _X, "'20%'", _V, _T] for k in (0, 1, 2, 3)} | {4: ["'Итого'", *["'1,00'"] * 9], 5: [f"'{i}'" for i in range(1, 11)], 6: ["'мало'", "'1'"]}


def _rows(spark, root, forms: dict[int, list[str]]):
    table(spark, root, "lineitem").createOrReplaceTempView("_cell_items")
    cells = f"CASE {_K} " + " ".join(f"WHEN {k} THEN array({', '.join(x)})" for k, x in sorted(forms.items())) + " END"
    return spark.sql(f"WITH i AS ({_ITEMS.replace('FROM lineitem', 'FROM _cell_items')}) SELECT l_orderkey AS document_id, 1 AS page_no, rn AS row_no, {cells} AS cells FROM i")


@query(f"""WITH i AS ({_ITEMS}), k AS (SELECT *, CASE WHEN {_K} = 0 OR {_K} = 2 THEN rn * 2 END AS parsed, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS n FROM i WHERE {_K} IN (0, 1, 2))
 SELECT l_orderkey AS document_id, rn AS row_no, coalesce(parsed, n + greatest(coalesce(max(parsed - n) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS line_number, 'A/' || CAST(l_partkey AS VARCHAR) AS article, CAST(CAST(l_quantity AS INT) AS BIGINT) AS quantity, {_cents('l_extendedprice / l_quantity')} AS unit_price_incl_vat, {_cents('l_extendedprice')} AS amount_no_disc_incl_vat, 0.5 AS disc_amount,
 CASE WHEN {_K} < 2 THEN '20%' END AS vat_rate, CASE WHEN {_K} < 2 THEN {_cents('l_extendedprice * 0.2')} END AS vat_amount, CASE WHEN {_K} < 2 THEN {_cents('l_extendedprice * 1.2')} END AS total_with_disc_incl_vat FROM k""")
def invoice_item_rows(spark, root):
    kept = ("document_id", "row_no", "line_number", "article", "quantity", "unit_price_incl_vat", "amount_no_disc_incl_vat", "disc_amount", "vat_rate", "vat_amount", "total_with_disc_incl_vat")
    return documents.invoice_items(_rows(spark, root, _INVOICE)).select(*kept)


@query(f"""WITH i AS ({_ITEMS}) SELECT l_orderkey AS document_id, rn AS row_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS INT) AS line_number, CAST(48100000 + l_partkey AS VARCHAR) AS sku, 'Услуга' AS description, CASE WHEN {_K} % 2 = 1 THEN CAST(CAST(l_quantity AS INT) AS BIGINT) ELSE 1 END AS quantity, {_cents('l_extendedprice / l_quantity')} AS unit_price_excl_vat FROM i WHERE {_K} < 4""")
def account_item_rows(spark, root):
    return documents.account_items(_rows(spark, root, _ACCOUNT)).select("document_id", "row_no", "line_number", "sku", "description", "quantity", "unit_price_excl_vat")


_DAY = "lpad(CAST(1 + o_custkey % 28 AS STRING), 2, '0') || '.0' || CAST(1 + o_custkey % 9 AS STRING) || '.2024'"
_ACC = "'BY20OLMP' || lpad(CAST(o_custkey AS STRING), 20, '0')"
_TEXT = f"'Платежное поручение № ' || CAST(o_orderkey AS STRING) || ' (электронное) Дата: ' || {_DAY} || CASE WHEN o_orderkey % 2 = 0 THEN ' Срочный Х' ELSE ' Несрочный Х' END || ' Сумма и валюта: ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ',50 код валюты: 933 счет ' || {_ACC} || ' назначение платежа: за  товар ' || CAST(o_custkey AS STRING) || ' № документа: 5 дата поступления: ' || {_DAY} || ' 10:30'"


@query(f"""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS number, 'электронное' AS kind, {_DAY} AS document_date, o_orderkey % 2 = 0 AS urgent, o_orderkey % 2 = 1 AS non_urgent, floor(o_totalprice) + 0.5 AS amount, '933' AS currency_code, {_ACC} AS payer_account, 'за товар ' || CAST(o_custkey AS VARCHAR) AS purpose, {_DAY} || ' 10:30' AS receipt_date FROM orders""")
def payment_orders(spark, root):
    found = table(spark, root, "orders").select("o_orderkey", F.expr(_TEXT).alias("text")).select("o_orderkey", documents.payment_order(c("text")).alias("p"))
    names = {"number": "payment_order_number", "kind": "payment_order_type", **{n: n for n in ("document_date", "urgent", "non_urgent", "amount", "currency_code", "payer_account", "purpose", "receipt_date")}}
    return found.select("o_orderkey", *(c(f"p.{v}").alias(k) for k, v in names.items()))


#: Boxes of a page a few pixels apart: by suppliers, places of a coarse grid and a step of two.
_BOXES = "SELECT DISTINCT l_suppkey AS page_id, CAST(l_partkey % 5 * 40 + l_linenumber * 2 AS INT) AS x FROM lineitem"


@query(f"""WITH RECURSIVE b AS ({_BOXES}), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x) AS k FROM b), t AS (SELECT page_id, k, x, x AS kept FROM n WHERE k = 1 UNION ALL SELECT n.page_id, n.k, n.x, CASE WHEN abs(n.x - t.kept) <= 3 THEN t.kept ELSE n.x END FROM t JOIN n ON n.page_id = t.page_id AND n.k = t.k + 1)
 SELECT page_id, count(DISTINCT kept) AS boxes, min(kept) AS first, max(kept) AS last FROM t GROUP BY 1""")
def distinct_boxes(spark, root):
    """Boxes of a page that differ from the one kept before by more than three pixels somewhere."""
    table(spark, root, "lineitem").createOrReplaceTempView("_box_items")
    box = F.array(c("x"), c("x") + 10, c("x") + 50, c("x") + 60)
    kept = spark.sql(_BOXES.replace("FROM lineitem", "FROM _box_items")).groupBy("page_id").agg(F.collect_list(box).alias("b")).withColumn("b", boxes.distinct_boxes(c("b")))
    return kept.select("page_id", F.size("b").cast("long").alias("boxes"), F.element_at("b", 1)[0].alias("first"), F.element_at("b", -1)[0].alias("last"))


#: A line over a wide region with a narrow one inside it, beside it or nowhere near.
_OVER = "SELECT o_orderkey AS page_id, CAST(o_custkey % 4 AS INT) AS k FROM orders"


@query(f"""WITH o AS ({_OVER}) SELECT page_id, 1 AS region_id, CASE k WHEN 0 THEN 'a b' WHEN 1 THEN 'a b c d e f g h' WHEN 2 THEN 'a b c d' ELSE 'a b c d e f g h' END AS part FROM o UNION ALL SELECT page_id, 2, CASE k WHEN 0 THEN 'c d' ELSE 'e f g h' END FROM o WHERE k IN (0, 2) UNION ALL SELECT page_id, 1, 'e f g h' FROM o WHERE k = 0""")
def smallest_region_parts(spark, root):
    """The words of a line dealt to the smallest region on each stretch of it."""
    table(spark, root, "orders").createOrReplaceTempView("_over_orders")
    o = spark.sql(_OVER.replace("FROM orders", "FROM _over_orders"))
    lines = o.select("page_id", F.lit(1).alias("item_id"), F.lit(0).alias("x1"), F.lit(10).alias("y1"), F.lit(80).alias("x2"), F.lit(20).alias("y2"), F.lit("a b c d e f g h").alias("text"))
    wide = o.select("page_id", F.lit(1).alias("region_id"), F.lit(0).alias("rx1"), F.lit(0).alias("ry1"), F.when(c("k") == 2, 40).otherwise(80).alias("rx2"), F.lit(40).alias("ry2"))
    narrow = o.filter("k <> 3").select("page_id", F.lit(2).alias("region_id"), F.when(c("k") == 0, 20).when(c("k") == 1, 20).otherwise(40).alias("rx1"), F.when(c("k") == 1, 30).otherwise(5).alias("ry1"), F.when(c("k") == 2, 80).otherwise(40).alias("rx2"), F.when(c("k") == 1, 40).otherwise(25).alias("ry2"))
    return boxes.split_over_smallest(lines, wide.union(narrow)).select("page_id", "region_id", "part")
