"""Rows of pages and documents: regions, lines around an anchor, numbering, matching by figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Fields of a figure signature and how far they may differ.
SIGNATURE = (("quantity", 0.01), ("price", 0.05), ("cost", 0.05), ("vat_amount", 0.05), ("cost_with_vat", 0.05))


def drop_by_role(regions: DataFrame) -> DataFrame:
    """Regions (doc_type, page_role, kind) that a page of this role keeps: headers on first, footers on last pages.

    Payment orders keep all, first pages of waybills their footer.
    """
    kind, role, doc = c("kind"), c("page_role"), c("doc_type")
    heads = kind.isin("header_box", "header_form_roi", "unp_cell")
    gone = F.when(role == "first", (kind == "footer_box") & (doc != "waybill")).when(role == "middle", heads | (kind == "footer_box")).when(role == "last", heads).otherwise(False)
    return regions.filter((doc == "payment_order") | ~gone)


def footer_guard(regions: DataFrame, page: str) -> DataFrame:
    """First pages of waybills whose footer begins 0 to 24 pixels below the table: the footer moves up over it and the
    table's last cells end above."""
    w = Window.partitionBy(page)
    bottom = F.max(F.when(c("kind") == "table_cell", c("y2"))).over(w)
    footer = F.min(F.when(c("kind") == "footer_box", c("y1"))).over(w)
    near = (c("doc_type") == "waybill") & (c("page_role") == "first") & (footer - bottom).between(0, 24) & (bottom - 16 > 0)
    out = regions.withColumns({"_b": bottom, "_near": F.coalesce(near, F.lit(False))})
    y1 = F.when(c("_near") & (c("kind") == "footer_box"), F.least(c("y1"), c("_b") - 14)).otherwise(c("y1"))
    y2 = F.when(c("_near") & (c("kind") == "table_cell") & (c("y2") >= c("_b") - 2) & (c("_b") - 16 - c("y1") >= 24), c("_b") - 16).otherwise(c("y2"))
    return out.withColumns({"y1": y1, "y2": y2}).drop("_b", "_near")


def layout_candidates(regions: DataFrame, page: str) -> DataFrame:
    """Pages that look like waybills: a header box, ten table cells or more, and two tax cells or one header form."""
    n = lambda kind: F.count_if(c("kind") == kind)
    out = regions.groupBy(page).agg(n("header_box").alias("header_boxes"), n("table_cell").alias("table_cells"), n("unp_cell").alias("unp_cells"), n("header_form_roi").alias("header_forms"))
    head, cells, more = c("header_boxes") > 0, c("table_cells") >= 10, (c("unp_cells") >= 2) | (c("header_forms") >= 1)
    return out.withColumns({"is_candidate": head & cells & more, "score": head.cast("int") + cells.cast("int") + more.cast("int")})


def same_row_text(boxes: DataFrame, page: str, left: int = 20, right: int = 1200, least: float = 0.35) -> DataFrame:
    """For every box (id, x1, y1, x2, y2, text) of a page the texts of its row, from left to right."""
    a, b = boxes.alias("a"), boxes.alias("b")
    overlap = F.least(c("a.y2"), c("b.y2")) - F.greatest(c("a.y1"), c("b.y1"))
    lower = F.least(F.greatest(c("a.y2") - c("a.y1"), F.lit(1)), F.greatest(c("b.y2") - c("b.y1"), F.lit(1)))
    on = (c(f"a.{page}") == c(f"b.{page}")) & (c("b.x2") >= c("a.x1") - left) & (c("b.x1") <= c("a.x2") + right) & (overlap >= lower * least)
    texts = F.array_sort(F.collect_list(F.struct(c("b.x1").alias("x1"), c("b.id").alias("id"), c("b.text").alias("text"))))
    return a.join(b, on).groupBy(c(f"a.{page}").alias(page), c("a.id").alias("id")).agg(F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("row_text"))


def matching_label(anchors: DataFrame, labels: DataFrame, page: str, gap: int = 120) -> DataFrame:
    """For every anchor the best label of its page: on its row, or else nearest below within ``gap``."""
    a, b = anchors.alias("a"), labels.alias("b")
    overlap, below = F.least(c("a.y2"), c("b.y2")) - F.greatest(c("a.y1"), c("b.y1")), c("b.y1") - c("a.y2")
    band = F.when(overlap > 0, 0).when(below.between(0, gap), 1)
    score = F.struct(band, F.greatest(below, F.lit(0)), F.abs(c("b.x1") - c("a.x1")), F.abs(c("b.x2") - c("b.x1") - (c("a.x2") - c("a.x1"))), c("b.id"))
    both = a.join(b, (c(f"a.{page}") == c(f"b.{page}")) & (c("a.id") != c("b.id")) & band.isNotNull())
    return both.groupBy(c(f"a.{page}").alias(page), c("a.id").alias("id")).agg(F.min_by(c("b.id"), score).alias("label_id"))


def signature_matches(rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Pairs of a row and a candidate of the same ``key`` whose figures agree in three fields or more, and differ in none.

    Both have id, vat_rate and the fields of SIGNATURE; a figure that is missing on a side counts for neither.
    """
    a, b = rows.alias("a"), candidates.alias("b")
    known = lambda f: c(f"a.{f}").isNotNull() & c(f"b.{f}").isNotNull()
    clash, equal = F.lit(False), F.lit(0)
    for f, most in SIGNATURE:
        clash = clash | F.coalesce(F.abs(c(f"a.{f}") - c(f"b.{f}")) > most, F.lit(False))
        equal = equal + known(f).cast("int")
    clash = clash | F.coalesce(c("a.vat_rate") != c("b.vat_rate"), F.lit(False))
    equal = equal + known("vat_rate").cast("int")
    return a.join(b, (c(f"a.{key}") == c(f"b.{key}")) & ~clash & (equal >= 3)).select(c(f"a.{key}").alias(key), c("a.id").alias("id"), c("b.id").alias("candidate_id"), equal.alias("fields"))


def best_line(rows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """For every row (barcode, tokens) the first line (line_no, line) of its document that holds the barcode, else the
    one that holds most of its tokens, two at least."""
    both = rows.join(lines.withColumn("_low", F.lower("line")), key)
    coded = F.coalesce(c("line").contains(c("barcode")), F.lit(False))
    # words are counted once a pair, and not where the bar code stands: that line wins anyway
    hits = F.when(~coded, F.size(F.filter("tokens", lambda t: c("_low").contains(t))))
    both = both.select(key, "row_id", "line_no", coded.alias("_coded"), hits.alias("_hits"))
    out = both.groupBy(key, "row_id").agg(F.min(F.when(c("_coded"), c("line_no"))).alias("by_code"), F.min_by("line_no", F.struct(-c("_hits"), c("line_no"))).alias("best"), F.max("_hits").alias("hits"))
    return out.select(key, "row_id", F.coalesce("by_code", F.when(c("hits") >= 2, c("best"))).alias("line_no"))


def running_numbers(df: DataFrame, key: list[str], order: list, parsed: str) -> DataFrame:
    """``line_number``: the number read, else one more than the largest number so far (rows before count one each)."""
    w = Window.partitionBy(*key).orderBy(*order)
    n = F.row_number().over(w)
    ahead = F.max(c(parsed) - c("_n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_n", n).withColumn("line_number", F.coalesce(c(parsed), c("_n") + F.greatest(F.coalesce(ahead, F.lit(0)), F.lit(0))))
    return out.drop("_n")


def context_spans(lines: DataFrame, key: str) -> DataFrame:
    """For every line the texts of the spans around it: alone, with the one before, the one after, both, and two each way.

    Spans that hold the same lines as an earlier one (at the ends of a document) are left out.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    spans = [F.array_join(F.collect_list("line").over(w.rowsBetween(a, b)), "\n") for a, b in ((0, 0), (-1, 0), (0, 1), (-1, 1), (-2, 2))]
    return lines.select(key, "line_no", F.array_distinct(F.array(*spans)).alias("spans"))


def take_until_next(lines: DataFrame, key: str, own: Column, other: Column) -> DataFrame:
    """Lines of each document up to where, after the first line that is ``own``, one that is not but starts an ``other`` item comes."""
    w = Window.partitionBy(key).orderBy("line_no")
    seen = F.max(own.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stop = F.coalesce((seen == 1) & other & ~own, F.lit(False))
    return lines.withColumn("_stop", stop).withColumn("_stopped", F.max(c("_stop").cast("int")).over(w)).filter("_stopped = 0").drop("_stop", "_stopped")


def lead_pieces(lines: DataFrame, key: str, anchor: Column, tail: Column, back: int = 8, most: int = 4) -> DataFrame:
    """For every ``anchor`` line the up to ``most`` lines before it, of the last ``back``, that follow the last ``tail`` line."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-back, -1)
    before = F.collect_list(F.struct(tail.alias("tail"), c("line").alias("line"))).over(w)
    last = F.array_max(F.transform(before, lambda x, i: F.when(x["tail"], i).otherwise(F.lit(-1))))
    pieces = F.slice(F.transform(F.filter(before, lambda x, i: i > last), lambda x: x["line"]), 1, most)
    return lines.select(key, "line_no", anchor.alias("_a"), F.array_join(pieces, " ").alias("pieces")).filter("_a").drop("_a")


def shift_down(cells: DataFrame, key: list[str], row: str, stray: Column) -> DataFrame:
    """Text that a cell holds in place of the one below it in the column (``stray``) moves down one row, in front of what is there."""
    w = Window.partitionBy(*key).orderBy(row)
    out = cells.withColumn("_s", F.when(stray, c("text")))
    above = F.lag("_s").over(w)
    last = F.lead(F.lit(1)).over(w).isNull()
    return out.withColumn("text", F.concat_ws(" ", above, F.when(c("_s").isNull() | last, c("text")))).drop("_s")


def longest_gap_run(df: DataFrame, key: str, value: str, most: Column) -> DataFrame:
    """The longest run of values of each key in which none is further than ``most`` from the one before; the first of equal ones."""
    w = Window.partitionBy(key).orderBy(value)
    out = df.withColumn("_new", F.coalesce(c(value) - F.lag(value).over(w) > most, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = out.groupBy(key, "_run").agg(F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))
    return runs.groupBy(key).agg(F.max_by(F.struct("n", "first", "last"), F.struct(c("n"), -c("first"))).alias("r")).select(key, "r.*")


def dense_start(df: DataFrame, key: str, order: str, support: Column, least: int) -> DataFrame:
    """The first row of each key that begins two consecutive rows of ``least`` support or more."""
    w = Window.partitionBy(key).orderBy(order)
    dense = support >= least
    return df.withColumn("_d", dense & F.coalesce(F.lead(dense).over(w), F.lit(False))).groupBy(key).agg(F.min(F.when(c("_d"), c(order))).alias("start"))


def probe_next(lines: DataFrame, key: str, anchor: Column, value: Column, ahead: int = 4) -> DataFrame:
    """For every ``anchor`` line the first value found in the ``ahead`` lines after it."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, ahead)
    return lines.select(key, "line_no", anchor.alias("_a"), F.first(value, ignorenulls=True).over(w).alias("value")).filter("_a").drop("_a")
