"""Queries on table cells and on nested documents built from the standard tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import LINE, query
from ledgerloom.functions import normalise
from ledgerloom.operators import schema_walk, table_owners
from ledgerloom.sources.tables import table

c = F.col
_LINE = ", ".join(LINE)
#: Rows of a table on the page of an order: a narrow, a wide and a middling cell each, all a little askew, and a line near each.
_GRID = f"SELECT l_orderkey AS page_id, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS rn FROM lineitem"
_COLUMNS = ((100, 240), (250, 600), (600, 700))
_CELLS = " UNION ALL ".join(f"SELECT page_id, rn, rn * 10 + {k} AS region_id, CAST({a} AS DOUBLE) AS x1, CAST(rn * 30 + l_partkey % 3 AS DOUBLE) AS y1, CAST({b} AS DOUBLE) AS x2, CAST(rn * 30 + 24 + l_suppkey % 3 AS DOUBLE) AS y2 FROM g" for k, (a, b) in enumerate(_COLUMNS))
#: The same cells from one reading of the items.
_CELL_ROWS = f"SELECT page_id, inline(array({', '.join(f'named_struct("region_id", rn * 10 + {k}, "x1", CAST({a} AS DOUBLE), "y1", CAST(rn * 30 + l_partkey % 3 AS DOUBLE), "x2", CAST({b} AS DOUBLE), "y2", CAST(rn * 30 + 24 + l_suppkey % 3 AS DOUBLE))' for k, (a, b) in enumerate(_COLUMNS))})) FROM g"
_TEXTS = "CASE l_partkey % 3 WHEN 0 THEN '12,50 краска белая' WHEN 1 THEN 'слово' ELSE '7.25 х' END"
_LINES = f"SELECT page_id, rn AS item_id, CAST(90 + l_partkey % 500 AS DOUBLE) AS x1, CAST(rn * 30 + l_partkey % 41 - 20 AS DOUBLE) AS y1, CAST(90 + l_partkey % 500 + 20 + l_suppkey % 200 AS DOUBLE) AS x2, CAST(rn * 30 + l_partkey % 41 - 10 + l_suppkey % 15 AS DOUBLE) AS y2, {_TEXTS} AS text FROM g"


@query(f"""WITH g AS ({_GRID}), cell AS ({_CELLS}), line AS ({_LINES}), band AS (SELECT page_id, rn, min(y1) AS top, max(y2) AS bottom FROM cell GROUP BY 1, 2),
 met AS (SELECT l.*, b.rn, row_number() OVER (PARTITION BY l.page_id, l.item_id ORDER BY CAST((y1 + y2) / 2 BETWEEN top AND bottom AS INT) DESC, least(y2, bottom) - greatest(y1, top) DESC, abs((top + bottom) / 2 - (y1 + y2) / 2), b.rn) AS place FROM line l JOIN band b ON l.page_id = b.page_id AND least(y2, bottom) > greatest(y1, top)),
 hit AS (SELECT m.page_id, m.item_id, m.text, s.region_id, s.x1 AS left_, s.x2 - s.x1 AS width, least(m.x2, s.x2) - greatest(m.x1, s.x1) AS shared FROM met m JOIN cell s ON m.page_id = s.page_id AND m.rn = s.rn WHERE place = 1 AND least(m.x2, s.x2) > greatest(m.x1, s.x1)),
 ranked AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY page_id, item_id ORDER BY left_) AS k, row_number() OVER (PARTITION BY page_id, item_id ORDER BY shared DESC, left_) AS best, first(width) OVER (PARTITION BY page_id, item_id ORDER BY left_) AS w1, last(width) OVER (PARTITION BY page_id, item_id ORDER BY left_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w2 FROM hit WINDOW w AS (PARTITION BY page_id, item_id)),
 two AS (SELECT *, n = 2 AND regexp_matches(text, '^[0-9]') AND w1 <= 160 AND w2 >= 250 AS split FROM ranked)
 SELECT page_id, item_id, region_id, CASE WHEN NOT split THEN text WHEN k = 1 THEN split_part(text, ' ', 1) ELSE substr(text, strpos(text, ' ') + 1) END AS part FROM two WHERE split OR best = 1""")
def table_cell_parts(spark, root):
    table(spark, root, "lineitem").createOrReplaceTempView("_grid_items")
    grid = f"WITH g AS ({_GRID.replace('FROM lineitem', 'FROM _grid_items')}) "
    cells, lines = spark.sql(grid + _CELL_ROWS), spark.sql(grid + _LINES)
    return table_owners.cell_parts(lines, cells)


@query(f"""WITH g AS ({_GRID}), cell AS ({_CELLS}) SELECT page_id, rn - 1 AS row_no, region_id, min(y1) OVER (PARTITION BY page_id, rn) AS top, max(y2) OVER (PARTITION BY page_id, rn) AS bottom FROM cell""")
def table_cell_rows(spark, root):
    table(spark, root, "lineitem").createOrReplaceTempView("_grid_items")
    cells = spark.sql(f"WITH g AS ({_GRID.replace('FROM lineitem', 'FROM _grid_items')}) " + _CELL_ROWS)
    return table_owners.table_rows(cells).select("page_id", "row_no", "region_id", "top", "bottom")


#: Fields of an order's document as text, and of its items; some bear the mark of doubt, one item in eleven is a total.
_HEAD = {"number": "' № ' || CAST(o_orderkey AS STRING) || ' ,'", "document_date": "CAST(1 + o_custkey % 28 AS STRING) || '.' || CAST(1 + o_custkey % 12 AS STRING) || '.2024'", "supplier": "'Поставщик: «Ива» ' || CAST(o_custkey AS STRING)", "account": "'ВУ' || CAST(10 + o_custkey % 90 AS STRING) || ' АКВВ О' || CAST(o_orderkey % 1000 AS STRING)", "urgent": "CASE o_orderkey % 4 WHEN 0 THEN 'Да' WHEN 1 THEN 'no' WHEN 2 THEN 'nan' ELSE 'может' END"}
_ITEM = {"name": "CASE WHEN l_partkey % 11 = 0 THEN ' Итого ' WHEN l_partkey % 2 = 0 THEN 'Крем. ' || CAST(l_partkey AS STRING) || ' мл' ELSE 'Мыло ,' || CAST(l_partkey AS STRING) END", "unit": "CASE l_suppkey % 4 WHEN 0 THEN 'Ш т.' WHEN 1 THEN 'упак' WHEN 2 THEN '' ELSE 'Кг' END", "quantity": "CAST(CAST(l_quantity AS INT) AS STRING) || ',5'", "price": f"CASE WHEN l_partkey % 7 = 0 THEN '{normalise.MARKER}' ELSE '1O' || CAST(l_linenumber AS STRING) || ',2 5' END", "vat_rate": "CASE WHEN l_suppkey % 5 = 0 THEN 'без' ELSE CAST(l_suppkey % 30 AS STRING) || ' ,50 %' END"}


def _documents(spark, root):
    """Documents of orders: number, date, supplier with a bank account, and items, all as text."""
    orders = table(spark, root, "orders").selectExpr("o_orderkey", *(f"{sql} AS {f}" for f, sql in _HEAD.items()))
    items = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr(f"struct({_LINE}, {', '.join(f'{sql} AS {f}' for f, sql in _ITEM.items())})"))).alias("items"))
    items = items.withColumn("items", F.transform("items", lambda x: F.struct(*(x[f].alias(f) for f in _ITEM), F.struct(*(x[f].alias(f) for f in LINE)).alias("place"))))
    doc = F.struct("number", "document_date", F.struct(c("supplier").alias("name"), F.struct(c("account")).alias("bank")).alias("supplier"), F.struct("urgent").alias("marks"), "items")
    return orders.join(items, c("o_orderkey") == c("l_orderkey")).select("o_orderkey", doc.alias("doc"))


@query("""SELECT o_orderkey, '№ ' || CAST(o_orderkey AS VARCHAR) AS number, lpad(CAST(1 + o_custkey % 28 AS VARCHAR), 2, '0') || '.' || lpad(CAST(1 + o_custkey % 12 AS VARCHAR), 2, '0') || '.2024' AS document_date,
 '"Ива" ' || CAST(o_custkey AS VARCHAR) AS supplier, 'BY' || CAST(10 + o_custkey % 90 AS VARCHAR) || 'AKBB0' || CAST(o_orderkey % 1000 AS VARCHAR) AS account, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS urgent FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def normalised_headers(spark, root):
    """Fields of nested documents at three depths, in one form by their names."""
    docs = schema_walk.normalise_documents(_documents(spark, root), "doc")
    return docs.select("o_orderkey", "doc.number", "doc.document_date", c("doc.supplier.name").alias("supplier"), "doc.supplier.bank.account", "doc.marks.urgent")


@query(f"""SELECT {_LINE}, CASE WHEN l_partkey % 2 = 0 THEN 'Крем, ' || CAST(l_partkey AS VARCHAR) || ' мл' ELSE 'Мыло, ' || CAST(l_partkey AS VARCHAR) END AS name, CASE l_suppkey % 4 WHEN 0 THEN 'шт' WHEN 1 THEN 'уп' WHEN 3 THEN 'кг' END AS unit,
 CAST(CAST(l_quantity AS INT) + CAST(l_quantity AS INT) % 2 AS BIGINT) AS quantity, CASE WHEN l_partkey % 7 <> 0 THEN CAST('10' || CAST(l_linenumber AS VARCHAR) || '.25' AS DOUBLE) END AS price, CASE WHEN l_suppkey % 5 = 0 THEN 'без' ELSE CAST(l_suppkey % 30 AS VARCHAR) || '.5%' END AS vat_rate FROM lineitem WHERE l_partkey % 11 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def normalised_items(spark, root):
    """Items of nested documents in one form, rows of totals left out."""
    docs = schema_walk.normalise_documents(_documents(spark, root), "doc").select(F.explode("doc.items").alias("x"))
    return docs.select(*(f"x.place.{f}" for f in LINE), *(f"x.{f}" for f in _ITEM))


@query(f"""WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}, {', '.join(_ITEM.values())}) - 1 AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
 SELECT l_orderkey AS o_orderkey, 'items[' || CAST(k AS VARCHAR) || '].price' AS path FROM n WHERE l_partkey % 7 = 0""")
def doubtful_paths(spark, root):
    docs = schema_walk.normalise_documents(_documents(spark, root), "doc")
    return docs.select("o_orderkey", F.explode("doubts").alias("path"))


#: Line items as pages of their order: each states some of the header, a bank, phones and up to two items.
_PAGE = {"number": "CASE WHEN l_linenumber % 2 = 0 THEN 'N' || CAST(l_partkey AS STRING) WHEN l_linenumber % 3 = 0 THEN ' ' END", "name": "CASE WHEN l_linenumber > 2 THEN 'S' || CAST(l_suppkey AS STRING) END", "account": "CASE WHEN l_partkey % 3 = 0 THEN 'A' || CAST(l_partkey AS STRING) END", "total": "CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_extendedprice AS DOUBLE) END"}
_PAGES = f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS page, CAST(l_partkey % 6 AS STRING) AS item, l_partkey % 4 AS more, l_suppkey, {', '.join(f'{sql} AS {f}' for f, sql in _PAGE.items())} FROM lineitem"


def _merged(spark, root):
    table(spark, root, "lineitem").createOrReplaceTempView("_page_items")
    pages = spark.sql(_PAGES.replace("FROM lineitem", "FROM _page_items"))
    item = lambda name: F.struct(name.alias("name"), F.lit("шт").alias("unit"), F.lit(1.0).alias("quantity"), c("page").alias("seen_on"))
    items = F.when(c("more") == 0, F.lit(None)).when(c("more") == 1, F.array(item(c("item")))).otherwise(F.array(item(c("item")), item(F.concat(F.lit(" "), (c("more") + 10).cast("string")))))
    phones = F.when(c("more") == 2, F.array(F.lit(" "))).when(c("more") == 3, F.array(F.concat(F.lit("+"), c("l_suppkey").cast("string"))))
    doc = F.struct("number", F.struct("name", F.struct("account").alias("bank"), phones.alias("phones")).alias("supplier"), items.alias("items"), F.struct("total").alias("totals"))
    return schema_walk.merge_pages(pages.select("l_orderkey", "page", doc.alias("doc")), "l_orderkey", "page", "doc", tail=("totals",))


@query(f"""WITH p AS ({_PAGES}) SELECT l_orderkey, arg_min(number, page) FILTER (WHERE trim(number) <> '') AS number, arg_min(name, page) FILTER (WHERE name IS NOT NULL) AS name, arg_min(account, page) FILTER (WHERE account IS NOT NULL) AS account,
 arg_min('+' || CAST(l_suppkey AS VARCHAR), page) FILTER (WHERE more = 3) AS phone, coalesce(arg_max_null(total, page), arg_min(total, page) FILTER (WHERE total IS NOT NULL)) AS total FROM p GROUP BY 1""")
def merged_headers(spark, root):
    """Pages of an order as one document: each field by the first page that has it, totals by the last."""
    return _merged(spark, root).select("l_orderkey", "doc.number", "doc.supplier.name", "doc.supplier.bank.account", c("doc.supplier.phones")[0].alias("phone"), "doc.totals.total")


@query(f"""WITH p AS ({_PAGES}), i AS (SELECT l_orderkey, page, 0 AS k, item AS name FROM p WHERE more > 0 UNION ALL SELECT l_orderkey, page, 1, ' ' || CAST(more + 10 AS VARCHAR) FROM p WHERE more > 1),
 o AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey, trim(name) ORDER BY page, k) = 1)
 SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY page, k) AS place, name, page AS seen_on FROM o""")
def merged_items(spark, root):
    return _merged(spark, root).select("l_orderkey", F.posexplode("doc.items").alias("k", "x")).select("l_orderkey", (c("k") + 1).alias("place"), "x.name", "x.seen_on")
