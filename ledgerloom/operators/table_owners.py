"""Lines of a waybill's page given to the cells of its table: first to a row of cells, then to a cell of that row.

Cells are page_id, region_id, x1, y1, x2, y2; lines are page_id, item_id, x1, y1, x2, y2, text. Rows and lines meet in
strips of a page, cells and lines by row, so nothing is compared over a whole page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_inline, strip_markup
from ledgerloom.operators.boxes import STRIP, by_line, overlap

c = F.col
# fixed values: how far cells of a row may differ, widths of a narrow cell beside a wide one, least width of a name cell
SAME_EDGES, SAME_MIDDLE, SAME_HEIGHT, NARROW, WIDE, NAME_WIDTH = 4, 4, 6, 160, 250, 180
#: A cell whose top lies this far below those of all cells before it fits no row of theirs, if no cell of the page is lower than 1:
#: middle and height then place its top within 4 + 6 / 2 of the row's.
APART = 8
_CELL = "struct<y1:double,x1:double,id:bigint,y2:double,x2:double>"


def _strips(df: DataFrame, top: str, bottom: str) -> DataFrame:
    return df.withColumn("_strip", F.explode(F.sequence(F.floor(c(top) / STRIP), F.floor(F.greatest(c(bottom), c(top)) / STRIP))))


def _joined(tops: list[float], bottoms: list[float], lefts: list[float], ordered: bool) -> list[int]:
    """Rows (from 0) of cells in order, each joining the row that it fits best. ``ordered``: rows left behind by ``APART`` are closed."""
    out, found = [], 0
    rows: list[list[float]] = []  # number, mean top, bottom, middle and height, left edge, cells
    for y1, y2, x1 in zip(tops, bottoms, lefts):
        if ordered:
            rows = [r for r in rows if y1 - r[1] <= APART]
        mid, tall, best = (y1 + y2) / 2, max(1.0, y2 - y1), None
        for r in rows:
            d1, d2, dm, dh = abs(y1 - r[1]), abs(y2 - r[2]), abs(mid - r[3]), abs(tall - r[4])
            if d1 <= SAME_EDGES and d2 <= SAME_EDGES or dm <= SAME_MIDDLE and dh <= SAME_HEIGHT:
                fit = (d1 + d2, dm, dh, abs(x1 - r[5]), r[0])
                if best is None or fit < best[0]:
                    best = fit, r
        if best is None:
            rows.append([found, y1, y2, mid, tall, x1, 1])
            out.append(found)
            found += 1
        else:
            r = best[1]
            n = r[6]
            r[1:5] = [(old * n + v) / (n + 1) for old, v in zip(r[1:5], (y1, y2, mid, tall))]
            r[5], r[6] = min(r[5], x1), n + 1
            out.append(r[0])
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells of pages to their rows: page_id, row_no, top, bottom, cells.

    A page falls apart where ``APART`` says so. A stretch whose edges all lie within reach of each other is one row; only
    the cells of other stretches are placed one by one.
    """
    for batch in batches:
        pages, lists = batch.columns
        cells, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not len(cells):
            continue
        y1, y2, x1 = (cells.field(f).to_numpy(zero_copy_only=False) for f in ("y1", "y2", "x1"))  # what is missing is NaN
        page = np.repeat(np.arange(len(pages)), sizes)
        heads = np.flatnonzero(np.diff(page, prepend=-1))
        ordered = np.logical_and.reduceat(y2 - y1 >= 1, heads).repeat(np.diff(heads, append=len(page)))
        new = np.ones(len(page), bool)
        new[1:] = (page[1:] != page[:-1]) | (y1[1:] - y1[:-1] > APART) & ordered[1:]
        starts = np.flatnonzero(new)
        spread = lambda y: np.maximum.reduceat(y, starts) - np.minimum.reduceat(y, starts)
        alike = (spread(y1) < SAME_EDGES - 0.01) & (spread(y2) < SAME_EDGES - 0.01)  # means are rounded
        counts, own = np.ones(len(starts), np.int64), np.zeros(len(page), np.int64)
        ends = np.append(starts[1:], len(page))
        for k in np.flatnonzero(~alike).tolist():
            a, b = starts[k], ends[k]
            own[a:b] = _joined(y1[a:b].tolist(), y2[a:b].tolist(), x1[a:b].tolist(), bool(ordered[a]))
            counts[k] = own[a:b].max() + 1
        row = own + np.repeat(np.cumsum(counts) - counts, ends - starts)
        order = np.argsort(row, kind="stable")
        firsts = np.flatnonzero(np.diff(row[order], prepend=-1))
        at = page[order][firsts]
        row_no = np.arange(len(firsts)) - np.searchsorted(at, at)
        tops, bottoms = np.fmin.reduceat(y1[order], firsts), np.fmax.reduceat(y2[order], firsts)
        if (order[1:] < order[:-1]).any():
            cells = cells.take(pa.array(order))
        held = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(page)), pa.int32()), cells)
        edge = lambda y: pa.array(y, mask=np.isnan(y))
        yield pa.RecordBatch.from_arrays([pages.take(pa.array(at)), pa.array(row_no, pa.int32()), edge(tops), edge(bottoms), held], ["page_id", "row_no", "top", "bottom", "cells"])


def _banded(cells: DataFrame) -> DataFrame:
    """page_id, row_no, top, bottom, cells (y1, x1, id, y2, x2): the rows of ``table_rows``, each with its cells."""
    edge = lambda f: F.nanvl(c(f).cast("double"), F.lit(None).cast("double")).alias(f)
    cell = F.struct(edge("y1"), edge("x1"), c("region_id").cast("long").alias("id"), edge("y2"), edge("x2"))
    pages = cells.groupBy("page_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return pages.mapInArrow(_bands, f"page_id {cells.schema['page_id'].dataType.simpleString()}, row_no int, top double, bottom double, cells array<{_CELL}>")


def table_rows(cells: DataFrame) -> DataFrame:
    """page_id, row_no (from 0, in order of discovery), region_id, x1, y1, x2, y2, top, bottom: cells in rows.

    Cells come from top to bottom, then from left to right. Each joins the row that it fits best: edges, else middle and
    height, near the running means of the row's cells; the least sum of edge distances wins, then middle, height, left
    edge, then the row found first. A page's cells are one array: pages are small, whatever the table. Edges that are no
    numbers count as missing; a cell without top or bottom is a row of its own.
    """
    rows = _banded(cells).select("page_id", "row_no", "top", "bottom", F.explode("cells").alias("s"))
    return rows.select("page_id", "row_no", c("s.id").alias("region_id"), "s.x1", "s.y1", "s.x2", "s.y2", "top", "bottom")


def _in_best_row(lines: DataFrame, bands: DataFrame, kept: list[str]) -> DataFrame:
    """page_id, item_id and the ``kept`` columns of a line and the row that it shares height with, see ``row_owner``."""
    both = _strips(lines, "y1", "y2").join(_strips(bands, "top", "bottom"), ["page_id", "_strip"])
    shared, mid = overlap("y1", "y2", "top", "bottom"), (c("y1") + c("y2")) / 2
    score = F.struct(mid.between(c("top"), c("bottom")).cast("int"), shared, -F.abs((c("top") + c("bottom")) / 2 - mid), -c("row_no"))
    pairs = both.filter(shared > 0).select("page_id", "item_id", F.struct(*kept).alias("o"), score.alias("_score"))
    return by_line(pairs).agg(F.max_by("o", "_score").alias("o")).select("page_id", "item_id", "o.*")


def row_owner(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """page_id, item_id, row_no: the row that a line shares height with: its middle inside first, then most height, then
    the nearest middle, then the row found first. Lines that meet no row have none."""
    bands = rows.select("page_id", "row_no", "top", "bottom").distinct()
    return _in_best_row(lines.select("page_id", "item_id", "y1", "y2"), bands, ["row_no"])


def cell_parts(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """page_id, item_id, region_id, part: lines on the table given to its cells; lines beside it have no row.

    In its row a line goes to the only cell that it meets; of two, a narrow one beside a wide one, an amount at the
    start goes to the left and the rest to the right; else the cell with most of the width has it, the left one of equals.
    Rows are found once and bring their cells along. ``item_id`` names one line of a page.
    """
    owned = _in_best_row(lines.select("page_id", "item_id", "x1", "x2", "y1", "y2", "text"), _banded(cells), ["x1", "x2", "text", "cells"])
    shared = lambda s: overlap(c("x1"), c("x2"), s["x1"], s["x2"]).cast("double")
    met = F.transform("cells", lambda s: F.struct(s["x1"].alias("left"), s["id"].alias("id"), F.greatest(F.lit(1.0), s["x2"] - s["x1"]).alias("width"), shared(s).alias("shared")))
    found = owned.select("page_id", "item_id", clean_inline(c("text")).alias("text"), F.array_sort(F.filter(met, lambda h: h["shared"] > 0)).alias("h"))
    part = lambda g: F.regexp_extract("text", r"^\s*([0-9]+[.,][0-9]{2})\s+(.+?)\s*$", g)
    first, second = F.try_element_at("h", F.lit(1)), F.try_element_at("h", F.lit(2))
    two = (F.size("h") == 2) & (first["width"] <= NARROW) & (second["width"] >= WIDE) & (second["left"] > first["left"]) & (part(1) != "")
    most = F.array_max(F.transform("h", lambda x: F.struct(x["shared"].alias("shared"), (-x["left"]).alias("left"), (-x["id"]).alias("id"))))
    one = lambda id_, text_: F.struct(id_.alias("region_id"), text_.alias("part"))
    parts = F.when(two, F.array(one(first["id"], part(1)), one(second["id"], part(2)))).when((F.size("h") > 0) & c("text").isNotNull(), F.array(one(-most["id"], c("text"))))
    return found.select("page_id", "item_id", F.inline(parts))


def visual_lines(items: DataFrame) -> DataFrame:
    """page_id, item_id, piece, x1, y1, x2, y2, text: the lines that a recognised item shows, cut at breaks, of equal height."""
    shown = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?i)<\s*br\s*/?\s*>|\n+"), lambda t: strip_markup(t)), lambda t: t.isNotNull())
    out = items.select("page_id", "item_id", "x1", "x2", "y1", "y2", F.size(shown).alias("_n"), F.posexplode(shown).alias("piece", "text"))
    high = F.greatest(F.lit(1.0), c("y2") - c("y1")) / c("_n")
    return out.select("page_id", "item_id", "piece", "x1", "x2", (c("y1") + high * c("piece")).alias("y1"), F.when(c("piece") == c("_n") - 1, c("y2").cast("double")).otherwise(c("y1") + high * (c("piece") + 1)).alias("y2"), "text")


def name_column(items: DataFrame, cells: DataFrame) -> DataFrame:
    """page_id, region_id, texts: what the shown lines of a page say in the name cells: the first cells, wide enough, of all
    rows but the first two. A line goes to the cell that holds its middle, then the one that shares most height, most
    width, the nearest middle, the upper one; a cell's texts stand in the order of items and their lines; null without any.
    """
    rows = table_rows(cells)
    by_height = F.dense_rank().over(Window.partitionBy("page_id").orderBy("top", "row_no"))
    first = F.row_number().over(Window.partitionBy("page_id", "row_no").orderBy("x1", "region_id"))
    names = rows.withColumns({"_place": by_height, "_cell": first}).filter((c("_cell") == 1) & (c("_place") > 2) & (c("x2") - c("x1") >= NAME_WIDTH))
    names = names.select("page_id", "region_id", *(c(f).alias("r" + f) for f in ("x1", "y1", "x2", "y2")))
    lines = visual_lines(items)
    both = _strips(lines, "y1", "y2").join(_strips(names, "ry1", "ry2"), ["page_id", "_strip"])
    wide, high, mid = overlap("x1", "x2", "rx1", "rx2"), overlap("y1", "y2", "ry1", "ry2"), (c("y1") + c("y2")) / 2
    score = F.struct(mid.between(c("ry1"), c("ry2")).cast("int"), high, wide, -F.abs((c("ry1") + c("ry2")) / 2 - mid), -c("ry1"), -c("region_id"))
    owned = both.filter((wide > 0) & (high > 0)).groupBy("page_id", "item_id", "piece").agg(F.max_by(F.struct("region_id", "text"), score).alias("o"))
    texts = owned.groupBy("page_id", c("o.region_id").alias("region_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "piece", "o.text"))), lambda s: s["text"]).alias("texts"))
    return names.select("page_id", "region_id").join(texts, ["page_id", "region_id"], "left")
