"""All queries of the library over the standard tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money_words, numbers, text
from ledgerloom.operators import boxes, documents, nested, ordered, quality, reconcile, segments
from ledgerloom.sources.tables import table
from ledgerloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "item_amount_recovery"
c, lit = F.col, F.lit
#: Together these tell every line item apart.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
_LINE = ", ".join(LINE)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, root: str) -> DataFrame:
    """Line items as document rows; some amounts are missing, by a rule on the key."""
    gap = (c("l_orderkey") * 7 + c("l_linenumber") * 3 + c("l_partkey")) % 9
    some = lambda k, v: F.when(gap != k, v)
    return table(spark, root, "lineitem").select(
        *LINE, "l_returnflag", some(0, c("l_quantity")).alias("quantity"), some(1, c("l_extendedprice") / c("l_quantity")).alias("price"), some(2, c("l_extendedprice")).alias("cost"),
        (c("l_tax") * 100).alias("vat_rate"), some(3, c("l_extendedprice") * c("l_tax")).alias("vat_amount"), some(4, c("l_extendedprice") + c("l_extendedprice") * c("l_tax")).alias("total"),
    )


_GAP = "(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 9"
_ITEMS = f"""items AS (SELECT {_LINE}, l_returnflag, CASE WHEN {_GAP} <> 0 THEN l_quantity END AS quantity, CASE WHEN {_GAP} <> 1 THEN l_extendedprice / l_quantity END AS price,
 CASE WHEN {_GAP} <> 2 THEN l_extendedprice END AS cost, l_tax * 100 AS vat_rate, CASE WHEN {_GAP} <> 3 THEN l_extendedprice * l_tax END AS vat_amount,
 CASE WHEN {_GAP} <> 4 THEN l_extendedprice + l_extendedprice * l_tax END AS total FROM lineitem)"""
_FULL = f"""{_ITEMS}, i1 AS (SELECT * REPLACE (coalesce(cost, quantity * price) AS cost) FROM items), i2 AS (SELECT * REPLACE (coalesce(cost, total - vat_amount) AS cost) FROM i1),
 i3 AS (SELECT * REPLACE (coalesce(price, CASE WHEN quantity <> 0 THEN cost / quantity END) AS price) FROM i2), i4 AS (SELECT * REPLACE (coalesce(quantity, CASE WHEN price <> 0 THEN cost / price END) AS quantity) FROM i3),
 i5 AS (SELECT * REPLACE (coalesce(vat_amount, cost * vat_rate / 100) AS vat_amount) FROM i4), full_items AS (SELECT * REPLACE (coalesce(total, cost + vat_amount) AS total) FROM i5)"""


def _close(a: str, b: str, absolute: float = 0.05, relative: float = 0.015) -> str:
    return f"(abs(({a}) - ({b})) <= greatest({absolute}, abs({b}) * {relative}))"


@query(f"WITH {_FULL} SELECT {_LINE}, quantity, price, cost, vat_rate, vat_amount, total FROM full_items")
def item_amount_recovery(spark, root):
    return reconcile.recover_amounts(_items(spark, root)).select(*LINE, *reconcile.LINKED)


_OK = f"coalesce(quantity IS NOT NULL AND price IS NOT NULL AND cost IS NOT NULL AND vat_rate IS NOT NULL AND vat_amount IS NOT NULL AND total IS NOT NULL AND {_close('quantity * price', 'cost')} AND {_close('cost * vat_rate / 100', 'vat_amount', 0.03, 0.02)} AND {_close('cost + vat_amount', 'total')}, false)"


@query(f"WITH {_ITEMS} SELECT {_LINE}, NOT {_OK} AS review FROM items")
def item_finalize_marks(spark, root):
    return reconcile.mark_linked(_items(spark, root)).select(*LINE, "review")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%URGENT%'")
def documents_list_filtered(spark, root):
    return table(spark, root, "orders").filter((c("o_orderstatus") == "F") & c("o_orderpriority").contains("URGENT")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"""WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS items_total FROM lineitem GROUP BY 1)
 SELECT o_orderkey, o_totalprice, items_total, coalesce({_close('items_total', 'o_totalprice')}, false) AS agrees FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def totals_reconcile(spark, root):
    sums = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("items_total"))
    out = table(spark, root, "orders").join(sums, c("o_orderkey") == c("l_orderkey"), "left")
    return out.select("o_orderkey", "o_totalprice", "items_total", F.coalesce(numbers.close(c("items_total"), c("o_totalprice")), lit(False)).alias("agrees"))


@query(f"WITH {_ITEMS} SELECT l_orderkey, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 2) END AS cost_total, CASE WHEN count(quantity) = count(*) THEN round(sum(quantity), 2) END AS quantity_total FROM items GROUP BY 1")
def totals_all_or_nothing(spark, root):
    return reconcile.totals(_items(spark, root), "l_orderkey", ("cost", "quantity"))


@query(f"WITH {_ITEMS} SELECT {_LINE}, coalesce(cost, total - vat_amount) AS cost_full, coalesce(vat_amount, total - cost) AS vat_amount_full, coalesce(total, cost + vat_amount) AS total_full FROM items")
def totals_third_from_two(spark, root):
    return reconcile.third_from_two(_items(spark, root), "cost", "vat_amount", "total").select(*LINE, "cost_full", "vat_amount_full", "total_full")


@query("WITH n AS (SELECT l_orderkey, l_tax, count(*) AS k FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_tax, k AS votes FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC, l_tax) = 1")
def vat_rate_mode(spark, root):
    return reconcile.most_frequent(table(spark, root, "lineitem"), "l_orderkey", "l_tax")


@query(f"WITH {_ITEMS}, v AS (SELECT {_LINE}, cost AS a, quantity * price AS b, total - vat_amount AS d FROM items) SELECT {_LINE}, CASE WHEN coalesce({_close('a', 'b')}, false) OR coalesce({_close('a', 'd')}, false) THEN a WHEN coalesce({_close('b', 'a')}, false) OR coalesce({_close('b', 'd')}, false) THEN b WHEN coalesce({_close('d', 'a')}, false) OR coalesce({_close('d', 'b')}, false) THEN d END AS agreed FROM v")
def consensus_value(spark, root):
    return _items(spark, root).select(*LINE, reconcile.first_agreeing([c("cost"), c("quantity") * c("price"), c("total") - c("vat_amount")]).alias("agreed"))


@query("SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem")
def item_dedupe(spark, root):
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return rows.dropDuplicates()


@query(f"WITH {_ITEMS} SELECT l_returnflag, grouping(l_returnflag) AS is_total, count(*) AS rows, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS clean_rows FROM items GROUP BY ROLLUP (l_returnflag)")
def run_quality_rollup(spark, root):
    return quality.quality_rollup(_items(spark, root), "l_returnflag", ~reconcile.coherent())


@query("SELECT o_orderstatus, count(*) AS documents, count(*) FILTER (WHERE o_totalprice > 100000) AS large, min(o_orderkey) AS first_document FROM orders GROUP BY 1")
def run_stats(spark, root):
    return table(spark, root, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("documents"), F.count_if(c("o_totalprice") > 100000).alias("large"), F.min("o_orderkey").alias("first_document"))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderstatus = 'F' AS ready FROM orders WHERE o_orderstatus IN ('F', 'P')")
def export_queue(spark, root):
    return table(spark, root, "orders").filter(c("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderdate", "o_orderstatus", (c("o_orderstatus") == "F").alias("ready"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*) AS done_rate, count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0) AS settled_rate FROM orders GROUP BY 1")
def success_rate_variants(spark, root):
    done, settled = F.count_if(c("o_orderstatus") == "F"), F.count_if(c("o_orderstatus") != "P")
    rate = lambda a, b: (a * lit(100.0)).cast("double") / F.nullif(b, lit(0)).cast("double")
    return table(spark, root, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), rate(done, F.count("*")).alias("done_rate"), rate(done, settled).alias("settled_rate"))


@query(f"WITH {_ITEMS} SELECT l_orderkey, count(*) AS review_rows FROM items WHERE NOT {_OK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_review_docs(spark, root):
    return quality.hotspots(_items(spark, root), ["l_orderkey"], ~reconcile.coherent(), 20)


@query("""WITH f AS (SELECT l_orderkey, 'quantity' AS field, quantity AS v FROM items UNION ALL SELECT l_orderkey, 'price', price FROM items UNION ALL SELECT l_orderkey, 'cost', cost FROM items UNION ALL SELECT l_orderkey, 'vat_amount', vat_amount FROM items UNION ALL SELECT l_orderkey, 'total', total FROM items)
 SELECT field, count(*) AS review_rows FROM f WHERE v IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""".replace("WITH f", f"WITH {_ITEMS}, f", 1))
def review_hotspots(spark, root):
    fields = ["quantity", "price", "cost", "vat_amount", "total"]
    rows = _items(spark, root).unpivot(["l_orderkey"], fields, "field", "v")
    return quality.hotspots(rows, ["field"], c("v").isNull(), 10)


@query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'EDITED' END AS o_orderpriority FROM orders WHERE o_orderkey % 5 = 0)
 SELECT o.o_orderkey, CASE WHEN e.o_orderkey IS NOT NULL THEN e.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority, e.o_orderkey IS NOT NULL AS edited FROM orders o LEFT JOIN e USING (o_orderkey)""")
def override_join(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    edits = orders.filter("o_orderkey % 5 = 0").withColumn("o_orderpriority", F.when(c("o_orderkey") % 2 == 0, "EDITED"))
    return quality.overlay(orders, edits, "o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, count(o_orderkey) AS documents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def page_doc_left_join(spark, root):
    docs = table(spark, root, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("documents"))
    return table(spark, root, "customer").join(docs, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("documents", lit(0)).alias("documents"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_original_anti(spark, root):
    return table(spark, root, "customer").join(table(spark, root, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand, p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12', 'Brand#13') AS known FROM part")
def dictionary_semi_anti(spark, root):
    known = ("Brand#1", "Brand#2", "Brand#11", "Brand#12", "Brand#13")  # a dictionary of fixed size
    return table(spark, root, "part").select("p_partkey", "p_brand", c("p_brand").isin(*known).alias("known"))


_DAY = "datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))"


@query(f"""WITH i AS (SELECT {_LINE}, {_DAY} AS s, {_DAY} + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
 SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS other, a.l_partkey AS part, b.l_partkey AS other_part, greatest(a.s, b.s) AS start, least(a.e, b.e) AS stop FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND greatest(a.s, b.s) < least(a.e, b.e)""")
def range_overlap_join(spark, root):
    start = F.datediff(c("l_shipdate").cast("date"), lit("1990-01-01").cast("date"))
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", start.cast("long").alias("start"), (start + c("l_quantity").cast("long")).alias("stop"))
    both = ordered.overlaps(rows, rows, "l_orderkey", 64).filter("a_l_linenumber < b_l_linenumber")
    return both.select(c("a_l_orderkey").alias("l_orderkey"), c("a_l_linenumber").alias("line"), c("b_l_linenumber").alias("other"), c("a_l_partkey").alias("part"), c("b_l_partkey").alias("other_part"), F.greatest("a_start", "b_start").alias("start"), F.least("a_stop", "b_stop").alias("stop"))


@query("SELECT event_id, user_id, lead(event_id) OVER w AS next_id, coalesce(date_diff('second', ts, lead(ts) OVER w) <= 3600, false) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def nearest_neighbor(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", "ts"), F.date_trunc("second", F.lead("ts").over(w)))
    return table(spark, root, "events").select("event_id", "user_id", F.lead("event_id").over(w).alias("next_id"), F.coalesce(gap <= 3600, lit(False)).alias("near"))


@query("""WITH s AS (SELECT p_brand, p_size, count(*) AS parts, min(p_partkey) AS first_part FROM part GROUP BY 1, 2) SELECT a.p_brand, a.p_size, b.p_size AS other_size, a.parts * b.parts AS pairs FROM s a JOIN s b ON a.p_brand = b.p_brand AND b.p_size - a.p_size BETWEEN 1 AND 2""")
def tolerance_signature_match(spark, root):
    sizes = table(spark, root, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("parts"))
    near = sizes.select("p_brand", c("p_size").alias("other_size"), c("parts").alias("n")).withColumn("p_size", F.explode(F.array(c("other_size") - 1, c("other_size") - 2)))
    return sizes.join(near, ["p_brand", "p_size"]).select("p_brand", "p_size", "other_size", (c("parts") * c("n")).alias("pairs"))


@query(f"""WITH o AS (SELECT {_LINE}, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, {_LINE}) AS p FROM lineitem)
 SELECT {_LINE}, l_quantity, sum(CASE WHEN l_quantity - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, {_LINE} ROWS UNBOUNDED PRECEDING) AS cluster FROM o""")
def gap_cluster(spark, root):
    order = ["l_quantity", *LINE]
    rows = table(spark, root, "lineitem").select(*LINE, "l_quantity").withColumn("p", ordered.previous("l_quantity", ["l_orderkey"], order))
    return ordered.clusters(rows, ["l_orderkey"], order, c("l_quantity") - c("p") > 5).drop("p")


@query("""WITH o AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
 SELECT event_id, user_id, event_type, sum(CASE WHEN p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM o""")
def segment_islands(spark, root):
    order = ["ts", "event_id"]
    rows = table(spark, root, "events").withColumn("p", ordered.previous("event_type", ["user_id"], order))
    return ordered.clusters(rows, ["user_id"], order, c("p") != c("event_type"), "segment").select("event_id", "user_id", "event_type", "segment")


@query(f"""SELECT {_LINE}, CASE WHEN row_number() OVER w = 1 AND lead(1) OVER w IS NULL THEN 'single' WHEN row_number() OVER w = 1 THEN 'first' WHEN lead(1) OVER w IS NULL THEN 'last' ELSE 'middle' END AS page_role FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE})""")
def roles_first_middle_last(spark, root):
    return ordered.roles(table(spark, root, "lineitem").select(*LINE), ["l_orderkey"], list(LINE))


@query("SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations")
def blocks_by_start_line(spark, root):
    return ordered.clusters(table(spark, root, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], c("role") == "user", "block")


@query("""WITH o AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS opened, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w, 0) AS closed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, user_id, event_type FROM o WHERE opened > 0 AND closed = 0""")
def after_header_until_total(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda kind: F.sum(F.when(c("event_type") == kind, 1).otherwise(0)).over(w)
    return table(spark, root, "events").select("event_id", "user_id", "event_type", seen("view").alias("o"), seen("purchase").alias("x")).filter("o > 0 and x = 0").drop("o", "x")


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ') AS context FROM conversations")
def context_window(spark, root):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    return table(spark, root, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), " ").alias("context"))


@query("""WITH o AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), r AS (SELECT user_id, sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
 n AS (SELECT user_id, run, count(*) AS k FROM r GROUP BY 1, 2) SELECT user_id, max(k) AS longest_run FROM n GROUP BY 1""")
def longest_run(spark, root):
    return ordered.longest_runs(table(spark, root, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role")
def consecutive_dup_suppression(spark, root):
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role").withColumn("p", ordered.previous("role", ["conv_id"], ["turn"]))
    return rows.filter(~c("p").eqNullSafe(c("role"))).drop("p")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{4,}'), 1) AS i FROM documents),
 f AS (SELECT doc_id, w, min(i) AS i FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
 SELECT d.doc_id, coalesce(x.tokens, '') AS tokens FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM k WHERE n <= 8 GROUP BY 1) x USING (doc_id)""")
def ordered_distinct_tokens(spark, root):
    return table(spark, root, "documents").select("doc_id", F.array_join(text.significant_tokens(c("text")), " ").alias("tokens"))


_CLEAN = r"nullif(trim(regexp_replace({}, '[ \t\r\n\x0b\f\x{{a0}}]+', ' ', 'g')), '')"


@query(f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned_md5 FROM documents")
def clean_inline(spark, root):
    return table(spark, root, "documents").select("doc_id", F.md5(text.clean_inline(c("text"))).alias("cleaned_md5"))


_STRIPPED = _CLEAN.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, md5({_STRIPPED}) AS text_md5, length({_STRIPPED}) AS n FROM pages")
def strip_markup(spark, root):
    stripped = text.strip_markup(c("html"))
    return table(spark, root, "pages").select("page_id", F.md5(stripped).alias("text_md5"), F.length(stripped).cast("long").alias("n"))


@query("SELECT doc_id, md5(" + "".join("regexp_replace(" for _ in ".,;:!?-") + "text" + "".join(f", '[{m}]{{2,}}', '{m}', 'g')" for m in ".,;:!?-") + ") AS collapsed_md5 FROM documents")
def collapse_punct(spark, root):
    return table(spark, root, "documents").select("doc_id", F.md5(text.collapse_marks(c("text"))).alias("collapsed_md5"))


_WORDS = {"license": 3, "the": 1, "para": 2, "und": 2, "token": 4}


@query("WITH s AS (SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {n} ELSE 0 END" for w, n in _WORDS.items()) + " AS score FROM documents) SELECT doc_id, score, CASE WHEN score >= 6 THEN 'form' WHEN score >= 3 THEN 'letter' ELSE 'other' END AS page_type FROM s")
def keyword_score(spark, root):
    score = text.keyword_score(c("text"), _WORDS)
    return table(spark, root, "documents").select("doc_id", score.alias("score"), F.when(score >= 6, "form").when(score >= 3, "letter").otherwise("other").alias("page_type"))


@query("""SELECT doc_id, 2 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < length(text) AS few_letters, regexp_matches(text, '(aaaa|eeee|!!!|[.]{4})') AS runs,
 length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AND 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS shouting FROM documents""")
def noise_flags(spark, root):
    return table(spark, root, "documents").select("doc_id", text.noise(c("text")).alias("f")).select("doc_id", "f.*")


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) < 20 AS blank FROM documents")
def blank_page(spark, root):
    return table(spark, root, "documents").select("doc_id", (F.length(F.regexp_replace(F.coalesce("text", lit("")), "[^A-Za-z0-9]", "")) < 20).alias("blank"))


@query("SELECT doc_id, coalesce(try_cast(replace(nullif(regexp_extract(text, '([0-9]+[.,][0-9]+)', 1), ''), ',', '.') AS DOUBLE), try_cast(nullif(regexp_extract(text, '([0-9]{1,15})', 1), '') AS DOUBLE)) AS number FROM documents")
def numeric_token(spark, root):
    return table(spark, root, "documents").select("doc_id", numbers.first_number(c("text")).alias("number"))


@query(f"SELECT {_LINE}, CASE WHEN abs(r - 0) <= 0.75 THEN 0.0 WHEN abs(r - 10) <= 0.75 THEN 10.0 WHEN abs(r - 20) <= 0.75 THEN 20.0 WHEN abs(r - 25) <= 0.75 THEN 25.0 ELSE r END AS rate FROM (SELECT {_LINE}, l_tax * 250 AS r FROM lineitem)")
def percent_snap(spark, root):
    return table(spark, root, "lineitem").select(*LINE, numbers.snap_rate(c("l_tax") * 250).alias("rate"))


@query(f"SELECT {_LINE}, CASE WHEN abs(q - floor(q + 0.5)) <= 0.03 THEN floor(q + 0.5) ELSE q END AS quantity FROM (SELECT {_LINE}, l_quantity * 1.011 AS q FROM (SELECT * REPLACE (CAST(l_quantity AS DOUBLE) AS l_quantity) FROM lineitem))")
def qty_snap(spark, root):
    return table(spark, root, "lineitem").select(*LINE, numbers.snap_quantity(c("l_quantity") * 1.011).alias("quantity"))


@query(f"SELECT {_LINE}, ({' OR '.join(_close(f'v {op} {s}', 't') for s in ('10.0', '100.0', '1000.0') for op in '*/')}) AND NOT {_close('v', 't')} AS shifted FROM (SELECT {_LINE}, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice / 100 ELSE l_extendedprice END AS v, l_extendedprice AS t FROM lineitem)")
def decimal_shift(spark, root):
    v = F.when(c("l_linenumber") % 3 == 0, c("l_extendedprice") / 100).otherwise(c("l_extendedprice"))
    return table(spark, root, "lineitem").select(*LINE, numbers.decimal_shift(v, c("l_extendedprice")).alias("shifted"))


@query("SELECT o_orderkey, lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '.' || CAST(year(o_orderdate) AS VARCHAR) AS date_text FROM orders")
def date_normalize(spark, root):
    raw = F.concat_ws(".", F.day("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string"))
    return table(spark, root, "orders").select("o_orderkey", text.normalise_date(raw).alias("date_text"))


@query("SELECT r_regionkey, translate(upper(r_name || ' СМР'), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX') AS latin FROM region")
def homoglyph_translate(spark, root):
    return table(spark, root, "region").select("r_regionkey", text.latin_lookalikes(F.concat("r_name", lit(" СМР"))).alias("latin"))


@query("SELECT event_id, 'props.n' AS path, json_extract_string(props, '$.k') AS value FROM events".replace("props.n", "props.k"))
def flatten_fields(spark, root):
    return table(spark, root, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "value")).select("event_id", F.concat(lit("props."), "k").alias("path"), "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 7 = 1 THEN 'review' WHEN o_orderkey % 7 = 2 THEN 'invalid' WHEN o_orderkey % 7 = 3 THEN 'empty' ELSE 'ok' END AS state FROM orders")
def field_state(spark, root):
    k = c("o_orderkey") % 7
    value = F.when(k == 1, "проверить поле").when(k == 2, "NaN").when(k == 3, "  ").when(k > 3, c("o_orderstatus"))
    return table(spark, root, "orders").select("o_orderkey", text.field_state(value, "проверить поле").alias("state"))


@query(f"WITH {_ITEMS} SELECT l_orderkey, arg_min(cost, ({_LINE})) FILTER (WHERE cost IS NOT NULL) AS first_cost, arg_max(total, ({_LINE})) FILTER (WHERE total IS NOT NULL) AS last_total FROM items GROUP BY 1")
def first_present_merge(spark, root):
    key = F.struct(*LINE)
    return _items(spark, root).groupBy("l_orderkey").agg(F.min_by("cost", F.when(c("cost").isNotNull(), key)).alias("first_cost"), F.max_by("total", F.when(c("total").isNotNull(), key)).alias("last_total"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def event_log_recent(spark, root):
    return table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(spark, root):
    return jobs.without_repeats(table(spark, root, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


_STATE = "CASE event_type WHEN 'view' THEN 'uploaded' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query(f"""WITH s AS (SELECT user_id, ts, {_STATE} AS s FROM events) SELECT user_id, arg_max(s, (ts, list_position(['uploaded', 'processing', 'completed', 'failed'], s))) AS state, sum(CASE WHEN s = 'processing' THEN 1 ELSE 0 END) AS attempts, count(*) AS events FROM s GROUP BY 1""")
def job_fsm(spark, root):
    return jobs.job_states(table(spark, root, "events").withColumn("s", F.expr(_STATE)), "user_id", "ts", "s")


@query("SELECT doc_id, hit FROM (SELECT doc_id, unnest(['license', 'token', 'apache', 'password']) AS hit, lower(text) AS t FROM documents) WHERE contains(t, hit)")
def token_hit_match(spark, root):
    tokens = F.array(*map(lit, ("license", "token", "apache", "password")))  # a dictionary of fixed size
    return table(spark, root, "documents").select("doc_id", F.explode(F.filter(tokens, lambda t: F.lower("text").contains(t))).alias("hit"))




def _lines(spark, root):
    """Line items as recognised lines of pages, placed by their keys."""
    x, y = (c("l_linenumber") * 40).cast("int"), (c("l_partkey") % 5 * 20).cast("int")
    words = F.array_join(F.transform(F.sequence(lit(1), (c("l_suppkey") % 6 + 1).cast("int")), lambda i: F.concat(lit("w"), i.cast("string"))), " ")
    rows = table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return rows.select(c("l_orderkey").alias("page_id"), c("l_linenumber").cast("int").alias("item_id"), x.alias("x1"), y.alias("y1"), (x + 60 + (c("l_suppkey") % 50).cast("int")).alias("x2"), (y + 18).alias("y2"), words.alias("text"))


def _regions(spark, root):
    """Four overlapping columns on each page."""
    pages = table(spark, root, "lineitem").select(c("l_orderkey").alias("page_id")).distinct().withColumn("region_id", F.explode(F.sequence(lit(0), lit(3))))
    return pages.select("page_id", "region_id", (c("region_id") * 70).alias("rx1"), (c("region_id") * 10).alias("ry1"), (c("region_id") * 70 + 90).alias("rx2"), (c("region_id") * 10 + 60).alias("ry2"))


_LINES = """g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
 lines AS (SELECT l_orderkey AS page_id, CAST(l_linenumber AS INT) AS item_id, CAST(l_linenumber * 40 AS INT) AS x1, CAST(p % 5 * 20 AS INT) AS y1, CAST(l_linenumber * 40 + 60 + s % 50 AS INT) AS x2, CAST(p % 5 * 20 + 18 AS INT) AS y2, list_transform(range(1, s % 6 + 2), lambda i: 'w' || i) AS words FROM g)"""
_REGIONS = """regions AS (SELECT page_id, CAST(r AS INT) AS region_id, r * 70 AS rx1, r * 10 AS ry1, r * 70 + 90 AS rx2, r * 10 + 60 AS ry2 FROM (SELECT DISTINCT l_orderkey AS page_id FROM lineitem), range(4) t(r)),
 hits AS (SELECT l.*, r.* EXCLUDE (page_id) FROM lines l JOIN regions r ON l.page_id = r.page_id AND x1 < rx2 AND x2 > rx1 AND y1 < ry2 AND y2 > ry1)"""


@query(f"""WITH {_LINES}, {_REGIONS}, t AS (SELECT *, CAST(round_even((least(x2, rx2) - greatest(x1, rx1)) / greatest(1, x2 - x1) * len(words), 0) AS INT) AS take FROM hits),
 u AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY page_id, item_id ORDER BY rx1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, lead(1) OVER (PARTITION BY page_id, item_id ORDER BY rx1) IS NULL AS ends FROM t),
 v AS (SELECT page_id, item_id, region_id, array_to_string(list_slice(words, CAST(used + 1 AS INT), CASE WHEN ends THEN len(words) ELSE CAST(used + take AS INT) END), ' ') AS part FROM u) SELECT * FROM v WHERE part <> ''""")
def line_region_split(spark, root):
    return boxes.split_over_regions(_lines(spark, root), _regions(spark, root))


@query(f"""WITH {_LINES}, {_REGIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id, item_id ORDER BY CAST((x1 + x2) / 2 >= rx1 AND (x1 + x2) / 2 < rx2 AND (y1 + y2) / 2 >= ry1 AND (y1 + y2) / 2 < ry2 AS INT) DESC,
 least(y2, ry2) - greatest(y1, ry1) DESC, abs((y1 + y2) / 2 - (ry1 + ry2) / 2), least(x2, rx2) - greatest(x1, rx1) DESC, region_id) AS n FROM hits) SELECT page_id, item_id, region_id FROM o WHERE n = 1""")
def line_owner(spark, root):
    return boxes.best_region(_lines(spark, root), _regions(spark, root))


@query(f"""WITH {_LINES}, p AS MATERIALIZED (SELECT page_id, list({{x1: x1, y1: y1, x2: x2, y2: y2, w: array_to_string(words, ' ')}} ORDER BY y1, x1, item_id) AS l FROM lines GROUP BY 1),
 q AS (SELECT page_id, CAST(r AS INT) AS region_id, l FROM p, range(4) t(r)) SELECT page_id, region_id, array_to_string(list_transform(list_filter(l, lambda a: a.x1 < region_id * 70 + 90 AND a.x2 > region_id * 70 AND a.y1 < region_id * 10 + 60 AND a.y2 > region_id * 10), lambda a: a.w), ' ') AS text FROM q""")
def box_text(spark, root):
    return boxes.region_text(_lines(spark, root), _regions(spark, root))


@query(f"""WITH {_LINES}, n AS (SELECT a.page_id, a.item_id, b.item_id AS right_id, row_number() OVER (PARTITION BY a.page_id, a.item_id ORDER BY b.x1 - a.x2, abs(a.y1 - b.y1), b.item_id) AS k FROM lines a JOIN lines b ON a.page_id = b.page_id AND a.item_id <> b.item_id
 AND b.x1 - a.x2 BETWEEN 0 AND 120 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) >= 0.35 * 18) SELECT page_id, item_id, right_id FROM n WHERE k = 1""")
def right_neighbour(spark, root):
    return boxes.right_neighbours(_lines(spark, root), 120)


@query(f"WITH {_LINES}, r AS (SELECT page_id, round_even(y1 / 12, 0) AS b, count(*) AS n FROM lines GROUP BY 1, 2) SELECT page_id, count(*) AS rows_n, max(n) AS cols_n, CAST(sum(n) AS BIGINT) AS cells FROM r GROUP BY 1")
def layout_stats(spark, root):
    return boxes.layout_stats(_lines(spark, root))


_MIDDLE = "(cells[{k}].y1 + cells[{k}].y2) / 2.0"


@query(f"""WITH RECURSIVE {_LINES}, p AS (SELECT page_id, list({{x1: x1, y1: y1, x2: x2, y2: y2, text: array_to_string(words, ' ')}} ORDER BY x1, y1, x2, y2, array_to_string(words, ' ')) AS cells FROM lines GROUP BY 1),
 f AS (SELECT page_id, cells, 1 AS k, [{{mean: {_MIDDLE.format(k=1)}, n: 1, ix: [1]}}] AS bands FROM p
  UNION ALL SELECT page_id, cells, k + 1, CASE WHEN near = 0 THEN list_append(bands, {{mean: y, n: 1, ix: [k + 1]}}) ELSE list_transform(bands, lambda b, i: CASE WHEN i = near THEN {{mean: (b.mean * b.n + y) / (b.n + 1), n: b.n + 1, ix: list_append(b.ix, k + 1)}} ELSE b END) END
  FROM (SELECT *, coalesce(list_position(list_transform(bands, lambda b: abs(b.mean - y) <= 10), true), 0) AS near FROM (SELECT *, {_MIDDLE.format(k='k + 1')} AS y FROM f WHERE k < len(cells)))),
 d AS (SELECT page_id, cells, UNNEST(bands) AS b FROM f WHERE k = len(cells)), t AS (SELECT page_id, b.mean AS mean, b.n AS n, array_to_string(list_transform(b.ix, lambda i: cells[i].text), ' | ') AS line, list_transform(b.ix, lambda i: cells[i].x1) AS x FROM d)
 SELECT page_id, string_agg(line, chr(10) ORDER BY mean, n, x) AS lines FROM t GROUP BY 1""")
def row_banding(spark, root):
    cell = F.struct("x1", "y1", "x2", "y2", "text")
    pages = _lines(spark, root).groupBy("page_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return pages.select("page_id", F.array_join(boxes.row_texts(boxes.bands(c("cells"), 10, False)), "\n").alias("lines"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, round(o_totalprice, 2) AS amount FROM orders")
def money_words_round_trip(spark, root):
    orders = table(spark, root, "orders")
    spelt = money_words.money_in_words(F.round("o_totalprice", 2))
    whole = money_words.words_to_whole(money_words.whole_in_words(F.floor("o_totalprice")))
    return orders.select("o_orderkey", whole.alias("whole"), money_words.words_to_money(spelt).alias("amount"))


@query("SELECT n_nationkey, 'Всего ' || n_name AS name FROM nation")
def encoding_repair(spark, root):
    broken = lit("Всего ".encode().decode("cp1251"))
    return table(spark, root, "nation").select("n_nationkey", text.repair_encoding(F.concat(broken, "n_name")).alias("name"))


@query(f"SELECT {_LINE}, l_quantity AS quantity, l_extendedprice AS cost, CAST(round(l_tax * 100, 0) AS INT) || '%' AS vat_rate FROM lineitem")
def waybill_item_rows(spark, root):
    cells = F.array(F.concat(lit("part "), c("l_partkey").cast("string")), lit("шт."), F.translate(c("l_quantity").cast("decimal(18,2)").cast("string"), ".", ","), lit("1"), F.format_string("%.2f", "l_extendedprice"), F.concat(F.round(c("l_tax") * 100).cast("int").cast("string"), lit(" %")), lit("1"), lit("1,00"), lit(""))
    rows = table(spark, root, "lineitem").select(F.struct(*LINE).alias("document_id"), lit(1).alias("page_no"), lit(1).alias("row_no"), cells.alias("cells"))
    return documents.waybill_items(rows).select("document_id.*", c("quantity").cast("double").alias("quantity"), "cost", "vat_rate")


@query("SELECT DISTINCT l_orderkey AS document_id, CAST(l_partkey AS VARCHAR) AS sku, l_quantity AS quantity, l_extendedprice AS cost FROM lineitem")
def distinct_page_items(spark, root):
    items = table(spark, root, "lineitem").select(c("l_orderkey").alias("document_id"), c("l_linenumber").alias("page_no"), c("l_suppkey").alias("row_no"), c("l_partkey").cast("string").alias("sku"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("cost"))
    return documents.distinct_items(items).select("document_id", "sku", "quantity", "cost")


@query("SELECT user_id, event_type, count(*) AS fields, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS nulls FROM events GROUP BY 1, 2")
def nested_field_counts(spark, root):
    events = table(spark, root, "events").select("event_id", "user_id", "event_type", "props")
    found = nested.flatten(events, "event_id", "props").withColumn("state", text.field_state(c("value"), "проверить поле"))
    states = nested.document_counters(found, "event_id", "state").select("event_id", "nulls")
    return events.join(states, "event_id", "left").groupBy("user_id", "event_type").agg(F.count("*").alias("fields"), F.count_if(F.coalesce("nulls", lit(1)) > 0).alias("nulls"))


_BEST = "CASE WHEN greatest({0}) <= 0 THEN NULL " + " ".join(f"WHEN s{k} = greatest({{0}}) THEN '{t}'" for k, t in enumerate(segments.TYPES)) + " END"
_TALLIES = ", ".join(f"s{k}" for k in range(4))
_KIND = "CASE length(text) % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(segments.TYPES)) + " END"


@query(f"""WITH RECURSIVE p AS (SELECT CAST(conv_id AS STRING) AS source_id, CAST(turn AS INT) AS page_no, CAST(conv_id AS STRING) || '__p' || CAST(turn AS STRING) AS page_id, role = 'user' AS title, length(text) % 3 = 0 AS footer, {_KIND} AS kind FROM conversations WHERE NOT coalesce(length(text) < 10, false)),
 q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_no, page_id) AS n FROM p),
 f AS (SELECT q.*, 1 AS segment_no, {', '.join(f"CAST(kind IS NOT DISTINCT FROM '{t}' AS INT) AS s{k}" for k, t in enumerate(segments.TYPES))} FROM q WHERE n = 1
  UNION ALL SELECT source_id, page_no, page_id, title, footer, kind, n, segment_no + CAST(starts AS INT), {', '.join(f"CASE WHEN starts THEN 0 ELSE s{k} END + CAST(kind IS NOT DISTINCT FROM '{t}' AS INT)" for k, t in enumerate(segments.TYPES))}
  FROM (SELECT q.*, f.segment_no, {', '.join(f'f.s{k}' for k in range(4))}, coalesce(q.page_no <> f.page_no + 1, false) OR coalesce(q.kind = 'payment_order' AND q.title, false) OR coalesce(q.title AND f.footer, false) AS starts FROM f JOIN q ON q.source_id = f.source_id AND q.n = f.n + 1)),
 g AS (SELECT source_id, segment_no, count(*) AS pages, {', '.join(f"count(*) FILTER (WHERE kind = '{t}') AS s{k}" for k, t in enumerate(segments.TYPES))} FROM f GROUP BY 1, 2), t AS (SELECT *, coalesce({_BEST.format(_TALLIES)}, 'unknown') AS doc_type FROM g)
 SELECT f.source_id, f.page_no, f.page_id, f.segment_no, CASE WHEN pages = 1 THEN 'single' WHEN row_number() OVER w = 1 THEN 'first' WHEN row_number() OVER w = pages THEN 'last' ELSE 'middle' END AS page_role, 'doc_' || lpad(CAST(f.segment_no AS STRING), 2, '0') AS segment_id, doc_type FROM f JOIN t USING (source_id, segment_no) WINDOW w AS (PARTITION BY f.source_id, f.segment_no ORDER BY f.page_no, f.page_id)""")
def segmentation_full(spark, root):
    turns = table(spark, root, "conversations")
    title, kind = c("role") == "user", F.element_at(F.array(*map(lit, segments.TYPES)), (F.length("text") % 4 + 1).cast("int"))
    pages = turns.select(c("conv_id").cast("string").alias("source_id"), c("turn").cast("int").alias("page_no"), F.concat_ws("__p", "conv_id", "turn").alias("page_id"), (F.length("text") < 10).alias("blank"), title.alias("has_title"), (F.length("text") % 3 == 0).alias("has_footer"), lit(False).alias("continuation_like"), F.when(title, "first_candidate").alias("role_hint"), kind.alias("page_doc_type"), lit(None).cast("string").alias("hard_type"), F.create_map(kind, lit(1)).alias("scores"))
    found = segments.with_roles(segments.segments(pages))
    out = found.join(segments.segment_types(found, pages).select("source_id", "segment_no", "doc_type"), ["source_id", "segment_no"])
    return out.select("source_id", "page_no", "page_id", "segment_no", "page_role", "segment_id", "doc_type")
