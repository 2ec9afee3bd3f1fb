"""Queries on regions, lines, numbering, dates, codes and states over the standard tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import LINE, query
from ledgerloom.functions import money_words, scalars, text
from ledgerloom.operators import boxes, nested, quality, rows, runs, segments
from ledgerloom.sources.tables import file_kind, table
from ledgerloom.streaming import jobs

c, lit = F.col, F.lit
_LINE = ", ".join(LINE)


def _sql(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    return table(spark, root, name).selectExpr(*columns)


#: Line items as regions of pages; an order is a page.
_REGION = (
    "l_orderkey AS page", "CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS id", "CASE l_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'payment_order' ELSE 'waybill' END AS doc_type", "CASE l_orderkey % 5 WHEN 0 THEN 'middle' WHEN 1 THEN 'last' WHEN 2 THEN 'single' ELSE 'first' END AS page_role",
    "CASE l_partkey % 7 WHEN 0 THEN 'footer_box' WHEN 1 THEN 'header_box' WHEN 2 THEN 'header_form_roi' WHEN 3 THEN 'unp_cell' ELSE 'table_cell' END AS kind", "CAST(l_partkey * 13 % 900 AS INT) AS x1", "CAST(l_partkey * 13 % 900 + 20 + l_suppkey % 90 AS INT) AS x2",
    "CAST((l_partkey * 7 + l_suppkey) % 60 + CASE WHEN l_partkey % 7 = 0 THEN 75 ELSE 0 END AS INT) AS y1", "CAST((l_partkey * 7 + l_suppkey) % 60 + CASE WHEN l_partkey % 7 = 0 THEN 75 ELSE 0 END + 10 + l_linenumber * 3 AS INT) AS y2", "'t' || CAST(l_partkey AS STRING) AS text", *LINE,
)
_R = f"r AS (SELECT {', '.join(_REGION)} FROM lineitem)"
_BOX = "b AS (SELECT DISTINCT page, id, x1, y1, x2, y2, text FROM r)"


def _regions(spark, root):
    return _sql(spark, root, "lineitem", *_REGION)


def _boxes(spark, root):
    return _regions(spark, root).select("page", "id", "x1", "y1", "x2", "y2", "text").distinct()


@query(f"WITH {_R} SELECT {_LINE}, kind, page_role, doc_type FROM r WHERE doc_type = 'payment_order' OR NOT CASE page_role WHEN 'first' THEN kind = 'footer_box' AND doc_type <> 'waybill' WHEN 'middle' THEN kind IN ('header_box', 'footer_box', 'header_form_roi', 'unp_cell') WHEN 'last' THEN kind IN ('header_box', 'header_form_roi', 'unp_cell') ELSE false END")
def regions_by_role(spark, root):
    return rows.drop_by_role(_regions(spark, root)).select(*LINE, "kind", "page_role", "doc_type")


@query(f"""WITH {_R}, w AS (SELECT *, max(y2) FILTER (WHERE kind = 'table_cell') OVER p AS b, min(y1) FILTER (WHERE kind = 'footer_box') OVER p AS f FROM r WINDOW p AS (PARTITION BY page)),
 n AS (SELECT *, coalesce(doc_type = 'waybill' AND page_role = 'first' AND f - b BETWEEN 0 AND 24 AND b - 16 > 0, false) AS near FROM w)
 SELECT {_LINE}, kind, CASE WHEN near AND kind = 'footer_box' THEN least(y1, b - 14) ELSE y1 END AS y1, CASE WHEN near AND kind = 'table_cell' AND y2 >= b - 2 AND b - 16 - y1 >= 24 THEN b - 16 ELSE y2 END AS y2 FROM n""")
def footer_guard(spark, root):
    return rows.footer_guard(_regions(spark, root), "page").select(*LINE, "kind", "y1", "y2")


@query(f"""WITH {_R}, n AS (SELECT page, count(*) FILTER (WHERE kind = 'header_box') AS header_boxes, count(*) FILTER (WHERE kind = 'table_cell') AS table_cells, count(*) FILTER (WHERE kind = 'unp_cell') AS unp_cells, count(*) FILTER (WHERE kind = 'header_form_roi') AS header_forms FROM r GROUP BY 1)
 SELECT *, header_boxes > 0 AND table_cells >= 10 AND (unp_cells >= 2 OR header_forms >= 1) AS is_candidate, CAST(header_boxes > 0 AS INT) + CAST(table_cells >= 10 AS INT) + CAST(unp_cells >= 2 OR header_forms >= 1 AS INT) AS score FROM n""")
def layout_candidates(spark, root):
    return rows.layout_candidates(_regions(spark, root), "page")


_OVER = "least(a.y2, b.y2) - greatest(a.y1, b.y1)"


@query(f"""WITH {_R}, {_BOX} SELECT a.page, a.id, string_agg(b.text, ' ' ORDER BY b.x1, b.id) AS row_text FROM b a JOIN b ON a.page = b.page AND b.x2 >= a.x1 - 20 AND b.x1 <= a.x2 + 1200 AND {_OVER} >= least(greatest(a.y2 - a.y1, 1), greatest(b.y2 - b.y1, 1)) * 0.35 GROUP BY 1, 2""")
def same_row_text(spark, root):
    return rows.same_row_text(_boxes(spark, root), "page")


@query(f"""WITH {_R}, {_BOX}, s AS (SELECT a.page, a.id, b.id AS label_id, CASE WHEN {_OVER} > 0 THEN 0 WHEN b.y1 - a.y2 BETWEEN 0 AND 120 THEN 1 END AS band, greatest(b.y1 - a.y2, 0) AS gap, abs(b.x1 - a.x1) AS dx, abs(b.x2 - b.x1 - (a.x2 - a.x1)) AS dw FROM b a JOIN b ON a.page = b.page AND a.id <> b.id)
 SELECT page, id, label_id FROM s WHERE band IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY band, gap, dx, dw, label_id) = 1""")
def matching_label(spark, root):
    boxes = _boxes(spark, root)
    return rows.matching_label(boxes, boxes, "page")


_SIDE = ("l_orderkey", "CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS id", "l_quantity AS quantity", "CAST(l_linenumber AS DOUBLE) AS price", "CASE WHEN l_partkey % 3 > 0 THEN CAST(l_suppkey % 3 AS DOUBLE) END AS cost", "l_discount AS vat_amount", "CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 2 AS DOUBLE) END AS cost_with_vat", "CAST(l_tax AS STRING) AS vat_rate")


def _signature_sql() -> str:
    fields = (("quantity", 0.01), ("price", 0.05), ("cost", 0.05), ("vat_amount", 0.05), ("cost_with_vat", 0.05))
    known = " + ".join(f"CAST(a.{f} IS NOT NULL AND b.{f} IS NOT NULL AS INT)" for f in ("quantity", "price", "cost", "vat_amount", "cost_with_vat", "vat_rate"))
    clash = " OR ".join([f"coalesce(abs(a.{f} - b.{f}) > {t}, false)" for f, t in fields] + ["coalesce(a.vat_rate <> b.vat_rate, false)"])
    return f"WITH s AS (SELECT {', '.join(_SIDE)} FROM lineitem) SELECT a.l_orderkey, a.id, b.id AS candidate_id, {known} AS fields FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey WHERE NOT ({clash}) AND {known} >= 3"


@query(_signature_sql())
def figure_signatures(spark, root):
    side = _sql(spark, root, "lineitem", *_SIDE)
    return rows.signature_matches(side, side, "l_orderkey")


#: Words of a conversation's turns stand for lines of a page.
_LINES = "lines AS (SELECT conv_id, turn AS line_no, coalesce(text, '') AS line FROM conversations)"


def _lines(spark, root):
    return _sql(spark, root, "conversations", "conv_id", "turn AS line_no", "coalesce(text, '') AS line")


@query(f"""WITH {_LINES}, q AS (SELECT conv_id, line_no AS row_id, CASE WHEN line_no % 2 = 0 THEN substr(line, 5, 12) END AS barcode, list_slice(list_distinct(regexp_extract_all(lower(line), '[a-z]{{4,}}')), 1, 1000) AS tokens FROM lines),
 h AS (SELECT q.conv_id, q.row_id, line_no, coalesce(contains(line, barcode), false) AS coded, len(list_filter(tokens, lambda t: contains(lower(line), t))) AS hits FROM q JOIN lines USING (conv_id)),
 g AS (SELECT conv_id, row_id, min(line_no) FILTER (WHERE coded) AS by_code, max(hits) AS hits FROM h GROUP BY 1, 2), f AS (SELECT h.conv_id, h.row_id, min(line_no) AS best FROM h JOIN g ON h.conv_id = g.conv_id AND h.row_id = g.row_id AND h.hits = g.hits GROUP BY 1, 2)
 SELECT conv_id, row_id, coalesce(by_code, CASE WHEN hits >= 2 THEN best END) AS line_no FROM g JOIN f USING (conv_id, row_id)""")
def review_row_line(spark, root):
    lines = _lines(spark, root)
    wanted = lines.select("conv_id", c("line_no").alias("row_id"), F.when(c("line_no") % 2 == 0, F.substring("line", 5, 12)).alias("barcode"), F.array_distinct(F.regexp_extract_all(F.lower("line"), lit("([a-z]{4,})"), lit(1))).alias("tokens"))
    return rows.best_line(wanted, lines, "conv_id")


@query(f"""WITH n AS (SELECT {_LINE}, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_linenumber + l_suppkey % 4 AS INT) END AS parsed, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS n FROM lineitem)
 SELECT {_LINE}, coalesce(parsed, n + greatest(coalesce(max(parsed - n) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS line_number FROM n""")
def running_line_numbers(spark, root):
    items = _sql(spark, root, "lineitem", *LINE, "CASE WHEN l_partkey % 3 = 0 THEN CAST(l_linenumber + l_suppkey % 4 AS INT) END AS parsed")
    return rows.running_numbers(items, ["l_orderkey"], list(LINE), "parsed").select(*LINE, "line_number")


def _span(a: int, b: int) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN {side(a)} AND {side(b)})"


_SPANS = ((0, 0), (-1, 0), (0, 1), (-1, 1), (-2, 2))


@query(f"""WITH {_LINES}, s AS (SELECT conv_id, line_no, {', '.join(f'{_span(a, b)} AS s{k}' for k, (a, b) in enumerate(_SPANS))} FROM lines), u AS (SELECT conv_id, line_no, UNNEST([s0, s1, s2, s3, s4]) AS span, UNNEST([0, 1, 2, 3, 4]) AS k FROM s)
 SELECT conv_id, line_no, span, row_number() OVER (PARTITION BY conv_id, line_no ORDER BY min(k)) AS place FROM u GROUP BY 1, 2, 3""")
def context_spans(spark, root):
    return rows.context_spans(_lines(spark, root), "conv_id").select("conv_id", "line_no", F.posexplode("spans").alias("n", "span")).select("conv_id", "line_no", "span", (c("n") + 1).alias("place"))


_OWN, _NEXT = "line_no % 5 = 1", "length(line) % 3 = 0"


@query(f"""WITH {_LINES}, s AS (SELECT *, coalesce(max(CAST({_OWN} AS INT)) OVER (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 AND {_NEXT} AND NOT ({_OWN}), false) AS stop FROM lines)
 SELECT conv_id, line_no, line FROM s QUALIFY max(CAST(stop AS INT)) OVER (PARTITION BY conv_id ORDER BY line_no) = 0""")
def trim_before_next(spark, root):
    return rows.take_until_next(_lines(spark, root), "conv_id", F.expr(_OWN), F.expr(_NEXT))


@query(f"""WITH {_LINES}, t AS (SELECT *, length(line) % 5 = 0 AS tail FROM lines), p AS (SELECT a.conv_id, a.line_no, b.line_no AS n, b.line, b.tail, max(CASE WHEN b.tail THEN b.line_no END) OVER (PARTITION BY a.conv_id, a.line_no) AS last FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.line_no < a.line_no AND b.line_no >= a.line_no - 8 WHERE a.line_no % 3 = 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, line_no ORDER BY n) AS place FROM p WHERE n IS NOT NULL AND (last IS NULL OR n > last))
 SELECT a.conv_id, a.line_no, coalesce(string_agg(k.line, ' ' ORDER BY k.n), '') AS pieces FROM t a LEFT JOIN k ON a.conv_id = k.conv_id AND a.line_no = k.line_no AND k.place <= 4 WHERE a.line_no % 3 = 2 GROUP BY 1, 2""")
def lead_pieces(spark, root):
    return rows.lead_pieces(_lines(spark, root), "conv_id", F.expr("line_no % 3 = 2"), F.expr("length(line) % 5 = 0"))


@query("""WITH g AS (SELECT conv_id, turn % 2 AS col, turn AS row, CAST(length(coalesce(text, '')) AS STRING) AS text FROM conversations), s AS (SELECT *, CASE WHEN length(text) = 2 THEN text END AS s, lag(CASE WHEN length(text) = 2 THEN text END) OVER w AS above, lead(1) OVER w IS NULL AS final FROM g WINDOW w AS (PARTITION BY conv_id, col ORDER BY row))
 SELECT conv_id, col, row, concat_ws(' ', above, CASE WHEN s IS NULL OR final THEN text END) AS text FROM s""")
def index_shift(spark, root):
    cells = _sql(spark, root, "conversations", "conv_id", "turn % 2 AS col", "turn AS row", "CAST(length(coalesce(text, '')) AS STRING) AS text")
    return rows.shift_down(cells, ["conv_id", "col"], "row", F.length("text") == 2)


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), n AS (SELECT *, sum(CASE WHEN sec - prev <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS prev FROM e)),
 r AS (SELECT user_id, run, count(*) AS n, min(sec) AS first, max(sec) AS last FROM n GROUP BY 1, 2) SELECT user_id, n, first, last FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def longest_gap_run(spark, root):
    events = table(spark, root, "events").select("user_id", F.unix_timestamp("ts").alias("sec"))
    return rows.longest_gap_run(events, "user_id", "sec", lit(3600))


@query("""WITH k AS (SELECT l_partkey % 100 AS page, l_suppkey AS y, count(*) AS support FROM lineitem GROUP BY 1, 2), d AS (SELECT *, support >= 2 AND coalesce(lead(support >= 2) OVER (PARTITION BY page ORDER BY y), false) AS d FROM k) SELECT page, min(y) FILTER (WHERE d) AS start FROM d GROUP BY 1""")
def dense_start(spark, root):
    counts = table(spark, root, "lineitem").groupBy((c("l_partkey") % 100).alias("page"), c("l_suppkey").alias("y")).agg(F.count("*").alias("support"))
    return rows.dense_start(counts, "page", "y", c("support"), 2)


@query(f"""WITH {_LINES}, v AS (SELECT *, CASE WHEN length(line) % 4 = 0 THEN line END AS value FROM lines) SELECT a.conv_id, a.line_no, (SELECT b.value FROM v b WHERE b.conv_id = a.conv_id AND b.line_no > a.line_no AND b.line_no <= a.line_no + 4 AND b.value IS NOT NULL ORDER BY b.line_no LIMIT 1) AS value FROM v a WHERE a.line_no % 3 = 0""")
def probe_next(spark, root):
    return rows.probe_next(_lines(spark, root), "conv_id", F.expr("line_no % 3 = 0"), F.expr("CASE WHEN length(line) % 4 = 0 THEN line END"))


@query("SELECT doc_id, nullif(list_extract(regexp_extract_all(coalesce(text, ''), '[0-9]+'), -1), '') AS last_number, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers FROM documents")
def last_match(spark, root):
    last, numbers = runs.last_match(c("text"), "([0-9]+)")
    return table(spark, root, "documents").select("doc_id", last.alias("last_number"), numbers.alias("numbers"))


@query(f"WITH {_LINES}, k AS (SELECT conv_id, lower(trim(line)) AS key, min(line_no) AS line_no FROM lines GROUP BY 1, 2) SELECT conv_id, line_no, key FROM k WHERE key <> ''")
def distinct_lines(spark, root):
    return runs.first_lines(_lines(spark, root), "conv_id", "line_no", "line").select("conv_id", c("first").alias("line_no"), c("key_text").alias("key"))


@query("WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS done FROM events GROUP BY 1) SELECT user_id, len(list_filter(['view', 'click', 'purchase'], lambda x: NOT list_contains(done, x))) AS open_stages, len(list_filter(['view', 'click'], lambda x: NOT list_contains(done, x))) = 0 AS ready FROM s")
def stage_sets(spark, root):
    done = table(spark, root, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    return done.withColumns(runs.stages_left(c("done"), ["view", "click", "purchase"], ["view", "click"])).drop("done")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 250")
def documents_recent(spark, root):
    return runs.recent_documents(table(spark, root, "orders"), c("o_orderstatus") == "F", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'auto') AND c_nationkey % 2 = 0 AND c_acctbal < 0")
def client_filter(spark, root):
    return runs.matching(table(spark, root, "customer"), "auto", ["c_name", "c_mktsegment"], c("c_nationkey") % 2 == 0, c("c_acctbal") < 0).select("c_custkey")


@query("""WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS processing, count(*) FILTER (WHERE o_totalprice < 1000) AS failed FROM orders)
 SELECT *, CASE WHEN total > 0 THEN floor(completed * 1000.0 / total + 0.5) / 10 ELSE 0 END AS success_rate, CASE WHEN completed + failed > 0 THEN floor(completed * 1000.0 / (completed + failed) + 0.5) / 10 ELSE 100.0 END AS finished_rate FROM s""")
def run_rates(spark, root):
    """Both rates of success: of all documents, and of those that ended (100 while none has)."""
    return runs.rates(table(spark, root, "orders"), c("o_orderstatus") == "F", c("o_orderstatus") == "P", c("o_totalprice") < 1000)


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) FILTER (WHERE o_orderstatus <> 'F') AS attention, floor(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) * 100 + 0.5) / 100 AS ready_amount FROM orders")
def export_summary(spark, root):
    return runs.export_sums(table(spark, root, "orders"), c("o_orderstatus") == "F", c("o_totalprice"))


_PRESENT = "CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0.05 AS INT) + CAST(l_tax > 0.04 AS INT) + CAST(l_returnflag = 'R' AS INT)"


@query(f"SELECT l_orderkey, {_PRESENT} AS fields, l_linenumber AS page_no FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PRESENT} DESC, l_linenumber) = 1")
def best_page(spark, root):
    """The page of a document with most fields present, the first of equal ones."""
    present = [c("l_quantity") > 25, c("l_discount") > 0.05, c("l_tax") > 0.04, c("l_returnflag") == "R"]
    return runs.fullest_page(table(spark, root, "lineitem"), "l_orderkey", "l_linenumber", present)


@query("""WITH d AS (SELECT l_orderkey, count(*) AS fields, count(*) FILTER (WHERE l_tax = 0) AS review FROM lineitem GROUP BY 1) SELECT count(*) AS documents, count(*) FILTER (WHERE review = 0) AS clean_documents, floor(count(*) FILTER (WHERE review = 0) * 10000.0 / greatest(count(*), 1) + 0.5) / 100 AS clean_documents_pct,
 floor(sum(fields - review) * 10000.0 / greatest(sum(fields), 1) + 0.5) / 100 AS clean_fields_pct FROM d""")
def review_free_shares(spark, root):
    return runs.review_free(table(spark, root, "lineitem"), "l_orderkey", c("l_tax") == 0)


_NUMBER = "CASE l_partkey % 5 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN '00' || CAST(l_orderkey AS STRING) || '-' || CAST(l_suppkey AS STRING) WHEN 2 THEN 'N 0000' || CAST(l_suppkey AS STRING) WHEN 3 THEN CAST(l_orderkey * 100 + l_partkey AS STRING) ELSE '' END"


@query(f"WITH n AS (SELECT {_LINE}, regexp_replace({_NUMBER}, '[^0-9]', '', 'g') AS d FROM lineitem) SELECT {_LINE}, CASE WHEN length(d) BETWEEN 6 AND 8 AND length(ltrim(d, '0')) > 0 AND (length(d) = 7 OR length(ltrim(d, '0')) >= 5) THEN d END AS document_number FROM n")
def document_numbers(spark, root):
    return table(spark, root, "lineitem").select(*LINE, scalars.document_number(F.expr(_NUMBER)).alias("document_number"))


_DAY, _MONTH = "CAST(l_partkey % 28 + 1 AS STRING)", "CAST(l_suppkey % 12 + 1 AS STRING)"
_WORDS = "['" + "', '".join(scalars.MONTHS) + "']"
_DATE = "CASE l_orderkey % 5 WHEN 0 THEN {d} || '.' || {m} || '.2024' WHEN 1 THEN '  ' || {d} || '.' || {m} || '.2024   10:30' WHEN 2 THEN {d} || ' ' || {w} || ' 2024  г.' WHEN 3 THEN '2024-01-05' ELSE 'без  даты' END"


@query(f"""WITH p AS (SELECT {_LINE}, l_orderkey % 5 AS k, {_DAY} AS d, {_MONTH} AS m, {_WORDS}[CAST(l_suppkey % 12 + 1 AS INT)] AS w FROM lineitem)
 SELECT {_LINE}, CASE k WHEN 0 THEN lpad(d, 2, '0') || '.' || lpad(m, 2, '0') || '.2024' WHEN 1 THEN lpad(d, 2, '0') || '.' || lpad(m, 2, '0') || '.2024 10:30' WHEN 2 THEN d || ' ' || w || ' 2024 г.' WHEN 3 THEN '2024-01-05' ELSE 'без даты' END AS date_text,
 CASE k WHEN 0 THEN d || '.' || m || '.2024' WHEN 1 THEN d || '.' || m || '.2024' WHEN 2 THEN d || ' ' || w || ' 2024' END AS date_found FROM p""")
def date_texts(spark, root):
    month = F.element_at(F.array(*map(lit, scalars.MONTHS)), (c("l_suppkey") % 12 + 1).cast("int"))
    items = table(spark, root, "lineitem").withColumn("w", month).withColumn("s", F.expr(_DATE.format(d=_DAY, m=_MONTH, w="w")))
    return items.select(*LINE, scalars.date_text(c("s")).alias("date_text"), scalars.date_in(c("s")).alias("date_found"))


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def iso_times(spark, root):
    return table(spark, root, "events").select("event_id", scalars.iso_utc(F.unix_timestamp("ts")).alias("iso"))


_TEXT_NUMBER = "CASE l_partkey % 6 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ',5O' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' 25 р' WHEN 2 THEN 'I' || CAST(l_suppkey AS STRING) WHEN 3 THEN 'да' WHEN 4 THEN '' ELSE '1.2.3' END"
_PLAIN = "regexp_replace(translate(trim(regexp_replace(t, '[\\s ]+', ' ', 'g')), 'OОIІL,', '00111.'), '[^0-9.-]', '', 'g')"
_ZEROS = "translate(t, 'OОoо', '0000')"


@query(f"""WITH s AS (SELECT {_LINE}, {_TEXT_NUMBER} AS t FROM lineitem), p AS (SELECT {_LINE}, t, TRY_CAST({_PLAIN} AS DOUBLE) AS n, {_ZEROS} AS z FROM s)
 SELECT {_LINE}, floor(n * 100 + 0.5) / 100 AS number, CASE WHEN lower(trim(t)) IN ('true', '1', 'да', 'yes') THEN true WHEN lower(trim(t)) IN ('false', '0', 'нет', 'no') THEN false END AS flag,
 CAST(coalesce(replace(nullif(regexp_extract(z, '[0-9]+[.,][0-9]{{1,2}}'), ''), ',', '.'), nullif(regexp_extract(z, '([0-9]+)\\s+([0-9]{{2}})(?:[^0-9]|$)', 1), '') || '.' || regexp_extract(z, '([0-9]+)\\s+([0-9]{{2}})(?:[^0-9]|$)', 2), nullif(regexp_extract(z, '[0-9]+'), '')) AS DOUBLE) AS first_number FROM p""")
def text_numbers(spark, root):
    items = table(spark, root, "lineitem").withColumn("t", F.expr(_TEXT_NUMBER))
    return items.select(*LINE, scalars.number(c("t")).alias("number"), scalars.flag(c("t")).alias("flag"), scalars.first_number(c("t")).alias("first_number"))


_SCALED = "CASE l_partkey % 4 WHEN 0 THEN l_discount * 100 WHEN 1 THEN l_discount * 1000 WHEN 2 THEN l_discount * 10000 ELSE l_extendedprice END"


@query(f"""WITH s AS (SELECT {_LINE}, {_SCALED} AS v, l_discount AS r, l_quantity + l_discount / 2 AS q FROM lineitem) SELECT {_LINE}, CASE WHEN abs(r) < 1 AND abs(v) >= 10 THEN CASE WHEN abs(v / 100.0 - r) <= greatest(0.05, abs(r) * 0.25) THEN floor(v / 100.0 * 100 + 0.5) / 100 WHEN abs(v / 1000.0 - r) <= greatest(0.05, abs(r) * 0.25) THEN floor(v / 1000.0 * 100 + 0.5) / 100
 WHEN abs(v / 10000.0 - r) <= greatest(0.05, abs(r) * 0.25) THEN floor(v / 10000.0 * 100 + 0.5) / 100 ELSE v END ELSE v END AS rescaled, CASE WHEN q > 0 THEN CASE WHEN abs(q - floor(q + 0.5)) <= 0.03 THEN floor(q + 0.5) WHEN floor(q * 1000 + 0.5) > 0 THEN floor(q * 1000 + 0.5) / 1000 END END AS quantity,
 CASE WHEN l_tax * 100 > 1 THEN l_tax * 100 / 100 ELSE l_tax * 100 END AS rate, CASE WHEN abs(v - floor(v + 0.5)) < 0.000001 THEN floor(v + 0.5) ELSE floor(v * 100 + 0.5) / 100 END AS coerced FROM (SELECT s.*, l_tax FROM s JOIN (SELECT DISTINCT {_LINE}, l_tax FROM lineitem) USING ({_LINE}))""")
def scaled_numbers(spark, root):
    items = table(spark, root, "lineitem").withColumn("v", F.expr(_SCALED))
    tax = c("l_tax") * 100
    return items.select(*LINE, scalars.rescaled(c("v"), c("l_discount")).alias("rescaled"), scalars.quantity(c("l_quantity") + c("l_discount") / 2).alias("quantity"), scalars.rate(tax).alias("rate"), scalars.whole_or_cents(c("v")).alias("coerced"))


_KEYS = "CASE o_custkey % 4 WHEN 0 THEN array('sender', 'receiver', 'items', 'totals') WHEN 1 THEN array('Supplier', 'customer', 'items') WHEN 2 THEN array('payer', 'recipient') ELSE array('items') END"


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'invoice' END AS summary, CASE WHEN o_orderkey % 5 = 0 THEN 'Waybill_v2' WHEN o_orderkey % 5 = 1 THEN 'ACCOUNT' END AS wrapper, CASE WHEN o_orderkey % 3 = 0 THEN 'Товарная НАКЛАДНАЯ' END AS title, o_custkey % 4 AS k, o_orderstatus, o_totalprice FROM orders)
 SELECT o_orderkey, coalesce(summary, CASE wrapper WHEN 'Waybill_v2' THEN 'waybill' WHEN 'ACCOUNT' THEN 'account_prot' END, CASE WHEN title IS NOT NULL THEN 'waybill' END, CASE k WHEN 0 THEN 'waybill' WHEN 1 THEN 'invoice' WHEN 2 THEN 'payment_order' END, 'other') AS document_type,
 CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_totalprice > 100000 THEN 'processing' ELSE 'uploaded' END AS status FROM s""")
def inferred_type_and_status(spark, root):
    key = c("o_orderkey")
    kind = scalars.document_type(F.when(key % 7 == 0, "invoice"), F.when(key % 5 == 0, "Waybill_v2").when(key % 5 == 1, "ACCOUNT"), F.when(key % 3 == 0, "Товарная НАКЛАДНАЯ"), F.expr(_KEYS), lit("Other"))
    state = scalars.status(F.when(key % 11 == 0, "error").when(key % 11 == 1, "ok"), c("o_orderstatus") == "F", c("o_totalprice") > 100000)
    return table(spark, root, "orders").select("o_orderkey", kind.alias("document_type"), state.alias("status"))


@query("""SELECT c_custkey, (c_mktsegment IS NULL OR trim(c_mktsegment) = '' OR c_custkey % 4 = 0) AND c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS nothing FROM customer""")
def missing_values(spark, root):
    kept = table(spark, root, "customer").withColumn("v", F.struct(F.when(c("c_custkey") % 4 != 0, c("c_mktsegment")).alias("a"), F.when(c("c_custkey") % 3 == 0, F.array(lit(" "), lit(None))).otherwise(F.array(lit("x"))).alias("b"), F.struct(F.when(c("c_custkey") % 2 != 0, c("c_acctbal")).alias("d")).alias("e")))
    return kept.select("c_custkey", scalars.missing(c("v"), kept.schema["v"].dataType).alias("nothing"))


@query("WITH n AS (SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM n")
def recent_events(spark, root):
    """The newest 200 events, the oldest of them first."""
    return runs.recent_events(table(spark, root, "events"), "ts", "event_id").select("event_id", "user_id", "place")


@query("""WITH e AS (SELECT DISTINCT user_id FROM events) SELECT c_custkey AS file_id, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS event FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e)""")
def events_from_cards(spark, root):
    """One event made from the card of each document that has none."""
    cards, events = table(spark, root, "customer").withColumnRenamed("c_custkey", "file_id"), table(spark, root, "events").withColumnRenamed("user_id", "file_id")
    return runs.events_of_cards(cards, events, "file_id", c("c_acctbal") < 0)


@query("""SELECT l_orderkey, count(DISTINCT l_linenumber) AS pages, count(DISTINCT l_returnflag) AS segments, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS outputs, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page FROM lineitem GROUP BY 1""")
def document_manifest(spark, root):
    """Pages, segments and outputs of each document, as a run's summary lists them."""
    return runs.manifest(table(spark, root, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT c_custkey, CAST(c_acctbal < 0 AS INT) + CAST(c_nationkey % 2 = 0 AS INT) + CAST(length(c_mktsegment) > 8 AS INT) AS review_fields, c_acctbal < 0 OR c_nationkey % 2 = 0 OR length(c_mktsegment) > 8 AS review FROM customer")
def review_counts(spark, root):
    marks = {"quantity": c("c_acctbal") < 0, "price": c("c_nationkey") % 2 == 0, "cost": F.length("c_mktsegment") > 8}
    return table(spark, root, "customer").select("c_custkey", *(v.alias(k) for k, v in runs.review_marks(marks).items()))


_SHORT = "substr(p_name, 1, CAST(p_partkey % 30 AS INT))"


@query(f"""WITH t AS (SELECT p_partkey, {_SHORT} AS t, p_size % 5 = 0 AS title, p_size % 7 = 0 AS footer FROM part), u AS (SELECT *, length(regexp_replace(t, '\\s', '', 'g')) AS compact, regexp_extract_all(t, '[A-Za-zА-Яа-яЁё0-9]{{2,}}') AS w FROM t)
 SELECT p_partkey, (compact < 25 OR (length(array_to_string(w, '')) < 18 AND len(w) <= 3)) AND NOT title AND NOT footer AS blank FROM u""")
def blank_pages(spark, root):
    return table(spark, root, "part").select("p_partkey", segments.blank_page(F.expr(_SHORT), c("p_size") % 5 == 0, c("p_size") % 7 == 0).alias("blank"))


@query("""SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'payment_order' WHEN p_size % 13 = 0 THEN 'waybill' WHEN p_size % 17 = 0 THEN 'account_prot' WHEN greatest(p_size % 3, p_size % 4, p_size % 5, p_size % 2) <= 0 THEN 'unknown'
 WHEN p_size % 3 = greatest(p_size % 3, p_size % 4, p_size % 5, p_size % 2) THEN 'invoice' WHEN p_size % 4 = greatest(p_size % 3, p_size % 4, p_size % 5, p_size % 2) THEN 'waybill' WHEN p_size % 5 = greatest(p_size % 3, p_size % 4, p_size % 5, p_size % 2) THEN 'payment_order' ELSE 'account_prot' END AS page_type FROM part""")
def page_types(spark, root):
    size = c("p_size")
    scores = dict(zip(segments.TYPES, (size % 3, size % 4, size % 5, size % 2)))
    return table(spark, root, "part").select("p_partkey", segments.page_type(scores, size % 11 == 0, size % 13 == 0, size % 17 == 0).alias("page_type"))


@query("SELECT l_orderkey, l_linenumber AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_number FROM lineitem WHERE l_quantity > 10")
def renumbered_items(spark, root):
    kept = table(spark, root, "lineitem").filter("l_quantity > 10")
    return segments.renumber(kept, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", c("l_linenumber").alias("page_no"), "line_number")


@query("SELECT c_custkey, CAST(floor((CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT) + CAST(c_acctbal > 0 AS INT) + 1) / 5.0 * 100) AS BIGINT) AS progress FROM customer")
def stage_progress(spark, root):
    key = c("c_custkey")
    return table(spark, root, "customer").select("c_custkey", segments.progress([key % 2 == 0, key % 3 == 0, key % 5 == 0, c("c_acctbal") > 0, lit(True)]).alias("progress"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 + 1 < least(coalesce(CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey % 3 + 1 AS INT) END, 3), 3) THEN 'uploaded' ELSE 'failed' END AS state, o_custkey % 4 + 1 AS attempts FROM orders WHERE o_orderstatus = 'F'")
def job_retries(spark, root):
    failed = table(spark, root, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", "failed").alias("state"), (c("o_custkey") % 4).alias("attempts"), F.when(c("o_custkey") % 3 > 0, (c("o_custkey") % 3 + 1).cast("int")).alias("max_attempts"))
    return jobs.next_attempts(failed).select("o_orderkey", "state", "attempts")


@query("WITH s AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) SELECT user_id, ts FROM s WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def fresh_states(spark, root):
    events = table(spark, root, "events")
    states = events.groupBy("user_id").agg(F.max("ts").alias("ts")).join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return jobs.fresh(states, "ts", c("now")).select("user_id", "ts")


_PATH = "CASE p_partkey % 5 WHEN 0 THEN 'items[' || CAST(p_size AS STRING) || '].unit' WHEN 1 THEN 'totals.vat_total' WHEN 2 THEN 'sender.tax_id' WHEN 3 THEN 'a[3].b[12].c' ELSE 'number' END"


@query(f"SELECT p_partkey, regexp_replace({_PATH}, '\\[[0-9]+\\]', '[*]', 'g') AS path, CASE p_partkey % 5 WHEN 0 THEN 'items' WHEN 1 THEN 'totals' WHEN 2 THEN 'parties' ELSE 'header' END AS tag FROM part")
def path_tags(spark, root):
    return table(spark, root, "part").select("p_partkey", nested.general_path(F.expr(_PATH)).alias("path"), nested.catalog_tag(F.expr(_PATH)).alias("tag"))


@query("WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN '$.k' ELSE '$.items[*].k' END AS path, json_extract_string(props, '$.k') AS v, event_id FROM events) SELECT regexp_replace(path, '^[$][.]', '') AS path, count(*) AS leaves, count(*) FILTER (WHERE v IS NULL) AS nulls FROM l GROUP BY 1")
def leaf_statistics(spark, root):
    """Leaves and nulls for each general path of nested documents."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, root, "events").select("event_id", F.to_json(F.when(c("event_id") % 3 == 0, F.struct(k.alias("k"), F.lit(None).cast("array<struct<k:bigint>>").alias("items"))).otherwise(F.struct(F.lit(None).cast("bigint").alias("k"), F.array(F.struct(k.alias("k"))).alias("items")))).alias("doc"))
    leaves = nested.flatten(events, "event_id", "doc").withColumn("path", nested.general_path(c("path")))
    return leaves.groupBy("path").agg(F.count("*").alias("leaves"), F.count_if(c("value").isNull()).alias("nulls"))


_FILE = "'in/' || CAST(p_partkey AS STRING) || CASE p_size % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' WHEN 3 THEN '.csv' WHEN 4 THEN '.zip' ELSE '' END"


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'document' WHEN 3 THEN 'text' ELSE 'unknown' END AS kind FROM part")
def file_kinds(spark, root):
    return table(spark, root, "part").select("p_partkey", file_kind(F.expr(_FILE)).alias("kind"))


@query("SELECT DISTINCT 'doc' || CAST(l_orderkey AS STRING) AS stem, CAST(l_linenumber AS INT) AS page FROM lineitem")
def page_id_parts(spark, root):
    page = F.format_string("doc%d__p%04d", "l_orderkey", "l_linenumber")
    return table(spark, root, "lineitem").select(text.page_stem(page).alias("stem"), text.page_number(page).alias("page")).distinct()


@query("SELECT n_nationkey, n_name AS first, CAST(n_regionkey AS STRING) AS last, 3 AS cells FROM nation")
def pipe_cells(spark, root):
    cells = text.split_cells(F.concat(lit(" "), "n_name", lit(" |x|  "), c("n_regionkey").cast("string")))
    return table(spark, root, "nation").select("n_nationkey", F.element_at(cells, 1).alias("first"), F.element_at(cells, -1).alias("last"), F.size(cells).alias("cells"))


@query("SELECT p_partkey, CASE WHEN n < 1024 THEN format('{:d} B', n) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024.0) ELSE format('{:.1f} MB', n / 1048576.0) END AS shown FROM (SELECT p_partkey, CAST(p_size * p_size * p_size * 37 AS BIGINT) AS n FROM part)")
def size_texts(spark, root):
    return table(spark, root, "part").select("p_partkey", text.size_text((c("p_size") * c("p_size") * c("p_size") * 37).cast("long")).alias("shown"))


@query("SELECT n_nationkey, n_name || ' 7' AS part FROM nation")
def text_between(spark, root):
    line = F.concat(lit("Поставщик:  "), "n_name", lit("   7  Плательщик: x Основание: y"))
    return table(spark, root, "nation").select("n_nationkey", text.between(line, r"поставщик:\s*", ["основание", "плательщик"]).alias("part"))


@query("SELECT s_suppkey, 'BY20OLMP' || lpad(CAST(s_suppkey AS STRING), 20, '0') AS account, 'OLMPBY2X' AS bank, CAST(100000000 + s_suppkey AS STRING) AS tax FROM supplier")
def bank_details(spark, root):
    number = F.lpad(c("s_suppkey").cast("string"), 20, "0")
    line = F.concat(lit("р/с ВY20 OLMP "), number, lit(" в банке ОLМРBY2X, УНП "), (c("s_suppkey") + 100000000).cast("string"))
    return table(spark, root, "supplier").select("s_suppkey", text.account_number(F.concat(lit("BY20 OLMP "), number)).alias("account"), F.element_at(text.bank_codes(line), 1).alias("bank"), F.element_at(text.tax_ids(line), -1).alias("tax"))


@query("SELECT n_nationkey, n_name AS trimmed, CASE WHEN n_nationkey % 3 = 0 THEN 'проверить' WHEN n_nationkey % 3 = 1 THEN n_name END AS kept FROM nation")
def doubtful_text(spark, root):
    noisy = F.concat(lit("-- . "), "n_name", lit(" ;; |"))
    kept = text.clean_or_review(F.when(c("n_nationkey") % 3 != 2, c("n_name")).otherwise("  "), c("n_nationkey") % 3 == 0, "проверить")
    return table(spark, root, "nation").select("n_nationkey", text.trim_edge_noise(noisy).alias("trimmed"), kept.alias("kept"))


@query(f"WITH {_R} SELECT page, coalesce(string_agg(text, ' ' ORDER BY y1, x1, id) FILTER (WHERE (y1 + y2) / 2.0 >= 20 AND (y1 + y2) / 2.0 < 60), '') AS zone FROM (SELECT DISTINCT page, id, x1, y1, x2, y2, text FROM r) GROUP BY 1")
def zone_texts(spark, root):
    cells = F.array_sort(F.collect_list(F.struct("y1", "x1", "id", "y2", "x2", "text")))
    return _boxes(spark, root).groupBy("page").agg(cells.alias("cells")).select("page", boxes.zone_text(c("cells"), lit(20), lit(60)).alias("zone"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_document(spark, root):
    return quality.latest(table(spark, root, "orders"), ["o_custkey"], [F.desc("o_orderdate"), c("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# fixed values: the spelling of whole numbers, an independent list for the SQL
_ONES = "['', 'один', 'два', 'три', 'четыре', 'пять', 'шесть', 'семь', 'восемь', 'девять', 'десять', 'одиннадцать', 'двенадцать', 'тринадцать', 'четырнадцать', 'пятнадцать', 'шестнадцать', 'семнадцать', 'восемнадцать', 'девятнадцать']"
_TENS = "['', '', 'двадцать', 'тридцать', 'сорок', 'пятьдесят', 'шестьдесят', 'семьдесят', 'восемьдесят', 'девяносто']"
_HUNDREDS = "['', 'сто', 'двести', 'триста', 'четыреста', 'пятьсот', 'шестьсот', 'семьсот', 'восемьсот', 'девятьсот']"


@query(f"""WITH n AS (SELECT p_partkey, CAST(p_partkey % 999 + 1 AS INT) AS n FROM part) SELECT p_partkey, array_to_string(list_filter([{_HUNDREDS}[n // 100 + 1], CASE WHEN n % 100 < 20 THEN {_ONES}[n % 100 + 1] ELSE {_TENS}[n % 100 // 10 + 1] END, CASE WHEN n % 100 >= 20 THEN {_ONES}[n % 10 + 1] END], lambda x: x <> ''), ' ') AS spelt FROM n""")
def numbers_in_words(spark, root):
    return table(spark, root, "part").select("p_partkey", F.lower(F.trim(money_words.whole_in_words((c("p_partkey") % 999 + 1).cast("long")))).alias("spelt"))
