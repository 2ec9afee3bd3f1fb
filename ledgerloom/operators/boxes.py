"""Boxes on pages: recognised lines against regions, owners, neighbours, row bands and layout figures.

Lines are rows page_id, item_id, x1, y1, x2, y2, text; regions are rows page_id, region_id, rx1, ry1, rx2, ry2.
Joins meet by page and by horizontal strips of the page, so a page with very many boxes is shared out as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

#: Height of the strips by which boxes of a page meet.
STRIP = 64
_BAND = "array<struct<mean double, n int, cells array<struct<x1 int, pos int, y1 int, x2 int, y2 int, text string>>>>"


def overlap(a1, a2, b1, b2) -> Column:
    """Length that two intervals share, 0 if they only touch."""
    name = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(0), F.least(name(a2), name(b2)) - F.greatest(name(a1), name(b1)))


def _strips(df: DataFrame, top: str, bottom: str, name: str) -> DataFrame:
    strip = lambda v: F.floor(v / STRIP)
    return df.filter(F.col(top) < F.col(bottom)).withColumn(name, F.explode(F.sequence(strip(F.col(top)), strip(F.col(bottom) - 1))))


def meet(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Every line with every region of its page that it overlaps in both directions, once."""
    a, b = _strips(items, "y1", "y2", "_strip"), _strips(regions.withColumnRenamed("page_id", "_page"), "ry1", "ry2", "_other")
    both = a.join(b, (F.col("page_id") == F.col("_page")) & (F.col("_strip") == F.col("_other")))
    once = F.floor(F.greatest("y1", "ry1") / STRIP) == F.col("_strip")
    return both.filter(once & (overlap("y1", "y2", "ry1", "ry2") > 0) & (overlap("x1", "x2", "rx1", "rx2") > 0)).drop("_page", "_strip", "_other")


def by_line(pairs: DataFrame) -> GroupedData:
    """Pairs grouped by their line, dealt out by it before: the choice of one sorts its pairs, which the task that joined them
    would do as well, beside the sorts of its join."""
    return pairs.repartition("page_id", "item_id").groupBy("page_id", "item_id")


def _share_words(parts: DataFrame, order: list[str], from_: str, to: str) -> DataFrame:
    """Deal the words of a line to its parts by their widths; the last part takes the rest, empty parts go."""
    w = Window.partitionBy("page_id", "item_id").orderBy(*order)
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    take = F.bround((F.col(to) - F.col(from_)) / F.greatest(F.lit(1), F.col("x2") - F.col("x1")) * F.size(words)).cast("int")
    out = parts.withColumn("_take", take).withColumn("_used", F.coalesce(F.sum("_take").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    last = F.lead(F.lit(1)).over(w).isNull()
    out = out.withColumn("_n", F.when(last, F.greatest(F.lit(0), F.size(words) - F.col("_used"))).otherwise(F.col("_take")))
    part = F.array_join(F.slice(words, F.col("_used") + 1, F.col("_n")), " ")
    return out.withColumn("part", part).filter("part <> ''").drop("_take", "_used", "_n")


def split_over_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, item_id, region_id, part: the words of a line dealt to the regions it crosses, left to right."""
    hits = meet(items, regions).withColumn("_a", F.greatest("x1", "rx1")).withColumn("_b", F.least("x2", "rx2"))
    return _share_words(hits, ["rx1", "region_id"], "_a", "_b").select("page_id", "item_id", "region_id", "part")


def split_over_smallest(items: DataFrame, regions: DataFrame) -> DataFrame:
    """As ``split_over_regions`` where regions lie inside others: each stretch belongs to the smallest region on it."""
    area = (F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1"))
    hit = F.struct(area.alias("area"), F.col("rx1").alias("a"), F.col("ry1").alias("top"), F.col("region_id").alias("region_id"), F.col("rx2").alias("b"))
    lines = meet(items, regions).groupBy("page_id", "item_id", "x1", "x2", "text").agg(F.collect_list(hit).alias("hits"))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("hits", lambda h: F.greatest("x1", h.a)), F.transform("hits", lambda h: F.least("x2", h.b)))))
    lines = lines.withColumn("_e", edges)
    pieces = lines.select("*", F.posexplode(F.slice("_e", 1, F.size("_e") - 1)).alias("_i", "_a")).withColumn("_b", F.element_at("_e", F.col("_i") + 2))
    owner = F.array_min(F.filter("hits", lambda h: (h.a <= F.col("_a")) & (h.b >= F.col("_b"))))
    pieces = pieces.withColumn("region_id", owner.region_id).filter("region_id is not null").drop("hits", "_e")
    w = Window.partitionBy("page_id", "item_id").orderBy("_a")
    opens = ~F.col("region_id").eqNullSafe(F.lag("region_id").over(w)) | (F.lag("_b").over(w) != F.col("_a"))
    pieces = pieces.withColumn("_new", F.when(opens, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = pieces.groupBy("page_id", "item_id", "x1", "x2", "text", "region_id", "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return _share_words(runs, ["_a"], "_a", "_b").select("page_id", "item_id", "region_id", "part")


def best_region(items: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, item_id, region_id: one owner a line: centre inside first, then most height shared, nearest middle, most width."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = (cx >= F.col("rx1")) & (cx < F.col("rx2")) & (cy >= F.col("ry1")) & (cy < F.col("ry2"))
    score = F.struct(inside.cast("int"), overlap("y1", "y2", "ry1", "ry2"), -F.abs(cy - (F.col("ry1") + F.col("ry2")) / 2), overlap("x1", "x2", "rx1", "rx2"), -F.col("region_id"))
    return by_line(meet(items, regions).select("page_id", "item_id", "region_id", score.alias("_score"))).agg(F.max_by("region_id", "_score").alias("region_id"))


def region_text(items: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, region_id, text: all lines that touch a region, in reading order; '' where none does."""
    line = F.struct("y1", "x1", "item_id", "text")
    found = meet(items, regions).groupBy("page_id", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s.text), " ").alias("text"))
    return regions.select("page_id", "region_id").join(found, ["page_id", "region_id"], "left").fillna("", ["text"])


def right_neighbours(items: DataFrame, most: int, least_shared: float = 0.35) -> DataFrame:
    """page_id, item_id, right_id: the next line to the right within ``most`` pixels that shares enough height.

    Candidates meet in strips; the nearest wins, then the one whose top is nearest, then the smallest id.
    """
    other = items.select(F.col("page_id"), *(F.col(c).alias(d) for c, d in (("item_id", "region_id"), ("x1", "rx1"), ("y1", "ry1"), ("x2", "rx2"), ("y2", "ry2"))))
    a, b = _strips(items, "y1", "y2", "_strip"), _strips(other.withColumnRenamed("page_id", "_page"), "ry1", "ry2", "_other")
    both = a.join(b, (F.col("page_id") == F.col("_page")) & (F.col("_strip") == F.col("_other")) & (F.col("item_id") != F.col("region_id")))
    gap, shared = F.col("rx1") - F.col("x2"), overlap("y1", "y2", "ry1", "ry2")
    enough = shared >= least_shared * F.least(F.col("y2") - F.col("y1"), F.col("ry2") - F.col("ry1"))
    near = both.filter((gap >= 0) & (gap <= most) & (shared > 0) & enough)
    score = F.struct(gap, F.abs(F.col("y1") - F.col("ry1")), F.col("region_id"))
    return by_line(near.select("page_id", "item_id", "region_id", score.alias("_score"))).agg(F.min_by("region_id", "_score").alias("right_id"))


def below_neighbours(items: DataFrame, most: int, least_shared: float = 0.35) -> DataFrame:
    """page_id, item_id, right_id of the line below: the neighbour to the right on the page turned on its side."""
    turned = items.select("page_id", "item_id", F.col("y1").alias("x1"), F.col("x1").alias("y1"), F.col("y2").alias("x2"), F.col("x2").alias("y2"), "text")
    return right_neighbours(turned, most, least_shared).withColumnRenamed("right_id", "below_id")


def bands(cells: Column, tolerance: float, by_top: bool) -> Column:
    """Rows of cells (array of x1, y1, x2, y2, text): a cell joins the first row whose running mean is near.

    ``by_top``: cells come by (y1, x1) and compare tops, rows stay in order of discovery; else cells come as
    they are and compare centres, rows end up by centre. Cells of a row are in order of x1, ties as they came.
    """
    if by_top:
        keyed = F.transform(cells, lambda s, i: F.struct(s.y1.alias("a"), s.x1.alias("b"), i.alias("i"), s.alias("s")))
        cells = F.transform(F.array_sort(keyed), lambda t: t.s)
    numbered = F.transform(cells, lambda s, i: F.struct(s.x1.cast("int").alias("x1"), i.cast("int").alias("pos"), s.y1.cast("int").alias("y1"), s.x2.cast("int").alias("x2"), s.y2.cast("int").alias("y2"), s.text.alias("text")))

    def place(rows: Column, cell: Column) -> Column:
        y = cell.y1.cast("double") if by_top else (cell.y1 + cell.y2) / F.lit(2.0)
        at = F.array_position(F.transform(rows, lambda r: F.abs(r["mean"] - y) <= tolerance), True)
        new = F.array(F.struct(y.alias("mean"), F.lit(1).alias("n"), F.array(cell).alias("cells")))
        joined = lambda r: F.struct(((r["mean"] * r["n"] + y) / (r["n"] + 1)).alias("mean"), (r["n"] + 1).alias("n"), F.concat(r["cells"], F.array(cell)).alias("cells"))
        return F.when(at == 0, F.concat(rows, new)).otherwise(F.transform(rows, lambda r, i: F.when(i == at - 1, joined(r)).otherwise(r))).cast(_BAND)

    rows = F.aggregate(numbered, F.array().cast(_BAND), place)
    if not by_top:
        rows = F.array_sort(rows)
    return F.transform(rows, lambda r: F.array_sort(r["cells"]))


def row_texts(rows: Column) -> Column:
    """The texts of banded rows, cells parted by a bar; blank cells go."""
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(c.text, F.lit("")), r"\s+", " "))
    return F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, text), lambda t: t != ""), " | "))


def zone_text(cells: Column, top: Column, bottom: Column) -> Column:
    """The text of cells whose middle lies in [top, bottom), as they come."""
    held = F.filter(cells, lambda s: ((s.y1 + s.y2) / 2 >= top) & ((s.y1 + s.y2) / 2 < bottom))
    return F.trim(F.regexp_replace(F.array_join(F.transform(held, lambda s: s.text), " "), r"\s+", " "))


def distinct_boxes(boxes: Column, tolerance: int = 3) -> Column:
    """Drop a box (array of x1, y1, x2, y2) that differs from the one kept before it by few pixels in each place."""

    def keep(kept: Column, box: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = F.forall(F.zip_with(last, box, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(box)))

    return F.aggregate(F.array_sort(boxes.cast("array<array<int>>")), F.array().cast("array<array<int>>"), keep)


def gap_centres(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """key, cluster, centre, n: values of a key whose gaps stay within the tolerance, and their mean."""
    w = Window.partitionBy(key).orderBy(value)
    far = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    # equal values may share a frame: their gaps are 0
    out = df.select(key, value, far.alias("_far")).withColumn("cluster", F.sum("_far").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(key, "cluster").agg(F.avg(value).alias("centre"), F.count("*").alias("n"))


def layout_stats(items: DataFrame, pitch: int = 12) -> DataFrame:
    """page_id, rows_n, cols_n, cells: rows are tops rounded to the pitch, columns the fullest row."""
    rows = items.groupBy("page_id", (F.bround(F.col("y1") / pitch) * pitch).alias("_row")).agg(F.count("*").alias("_n"))
    return rows.groupBy("page_id").agg(F.count("*").alias("rows_n"), F.max("_n").alias("cols_n"), F.sum("_n").alias("cells"))
