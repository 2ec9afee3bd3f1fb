"""Queries on lines of tables as intervals, over orders as pages, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import query
from ledgerloom.operators import intervals, runs
from ledgerloom.sources.tables import table

c = F.col
#: Line items of an order as lines across and down its page.
_ACROSS = "SELECT l_orderkey AS page_id, CAST(l_partkey * 7 % 300 AS INT) AS spot, CAST(l_suppkey * 13 % 200 AS INT) AS first, CAST(l_suppkey * 13 % 200 + l_quantity * 3 AS INT) AS last FROM lineitem"
_DOWN = "SELECT l_orderkey AS page_id, CAST(l_suppkey * 5 % 260 AS INT) AS spot, CAST(l_partkey * 11 % 250 AS INT) AS first, CAST(l_partkey * 11 % 250 + l_linenumber * 20 AS INT) AS last FROM lineitem"


def _segments(spark, root):
    table(spark, root, "lineitem").createOrReplaceTempView("_segment_items")
    return [spark.sql(q.replace("FROM lineitem", "FROM _segment_items")).withColumnRenamed("spot", "at") for q in (_ACROSS, _DOWN)]


@query("""WITH d AS (SELECT DISTINCT l_suppkey, CAST(l_partkey AS INT) AS p FROM lineitem), r AS (SELECT *, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS run FROM d)
 SELECT l_suppkey, min(p) AS first, max(p) AS last FROM r GROUP BY l_suppkey, run HAVING count(*) >= 2""")
def point_runs(spark, root):
    points = table(spark, root, "lineitem").select("l_suppkey", c("l_partkey").cast("int").alias("p"))
    return intervals.point_runs(points, ["l_suppkey"], "p", 2)


@query(f"WITH a AS ({_ACROSS}), d AS ({_DOWN}) SELECT a.page_id, count(*) AS crossings FROM a JOIN d ON a.page_id = d.page_id AND d.spot BETWEEN a.first - 2 AND a.last + 2 AND a.spot BETWEEN d.first - 2 AND d.last + 2 GROUP BY 1")
def line_crossings(spark, root):
    return intervals.crossings(*_segments(spark, root)).groupBy("page_id").agg(F.count("*").alias("crossings"))


_PLACES = "SELECT DISTINCT page_id, spot, 20 AS low, 240 AS high FROM {}"


@query(f"WITH a AS ({_ACROSS}), d AS ({_DOWN}), p AS ({_PLACES.format('a')}) SELECT p.*, count(d.spot) AS support FROM p LEFT JOIN d ON p.page_id = d.page_id AND d.spot BETWEEN p.low AND p.high AND p.spot BETWEEN d.first - 2 AND d.last + 2 GROUP BY ALL")
def line_support(spark, root):
    across, down = _segments(spark, root)
    places = across.select("page_id", "at", F.lit(20).alias("low"), F.lit(240).alias("high")).distinct()
    return intervals.support(places, down).withColumnRenamed("at", "spot")


@query(f"""WITH d AS ({_DOWN}), p AS ({_PLACES.format('d')}), y AS (SELECT p.page_id, p.spot, unnest(range(greatest(d.first, low), least(d.last, high) + 1)) AS y FROM p JOIN d ON p.page_id = d.page_id AND abs(p.spot - d.spot) <= 3)
 SELECT p.*, count(DISTINCT y) / 221.0 AS coverage FROM p LEFT JOIN y ON p.page_id = y.page_id AND p.spot = y.spot GROUP BY ALL""")
def line_coverage(spark, root):
    down = _segments(spark, root)[1]
    places = down.select("page_id", "at", F.lit(20).alias("low"), F.lit(240).alias("high")).distinct()
    return intervals.coverage(places, down).withColumnRenamed("at", "spot")


@query(f"""WITH r AS (SELECT DISTINCT page_id, spot FROM ({_ACROSS})), k AS (SELECT DISTINCT page_id, spot FROM ({_DOWN})), y AS (SELECT page_id, spot AS y1, lead(spot) OVER w AS y2, row_number() OVER w AS row FROM r WINDOW w AS (PARTITION BY page_id ORDER BY spot)), x AS (SELECT page_id, spot AS x1, lead(spot) OVER w AS x2, row_number() OVER w AS col FROM k WINDOW w AS (PARTITION BY page_id ORDER BY spot)),
 g AS (SELECT page_id, row, col, least(x1 + 6, 249) AS x1, least(y1 + 6, 279) AS y1, greatest(least(x2 - 6, 249), 0) AS x2, greatest(least(y2 - 6, 279), 0) AS y2 FROM y JOIN x USING (page_id) WHERE y.y2 IS NOT NULL AND x.x2 IS NOT NULL)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY row, col) AS cell, row, col, x1, y1, x2, y2 FROM g WHERE x2 > x1 AND y2 > y1""")
def grid_cells(spark, root):
    across, down = (s.select("page_id", "at").distinct() for s in _segments(spark, root))
    pages = across.select("page_id", F.lit(250).alias("width"), F.lit(280).alias("height")).distinct()
    return intervals.cells_between(across, down, pages)


_ARCHIVED, _ORIGINAL = "'archive/' || CAST(s_suppkey AS STRING) || '/Supplier_' || CAST(s_suppkey AS STRING) || '.zip'", "'in/SUPPLIER ' || CAST(s_suppkey AS STRING) || '.PDF'"


@query(f"SELECT s_suppkey, {_ARCHIVED} AS path, CASE WHEN s_suppkey % 3 > 0 THEN {_ORIGINAL} END AS original, s_suppkey % 3 = 0 AS missing FROM supplier")
def archived_originals(spark, root):
    """Archived results with their originals, and those whose original is missing."""
    suppliers = table(spark, root, "supplier")
    originals = suppliers.filter("s_suppkey % 3 > 0").select(F.expr(_ORIGINAL).alias("path"))
    found, missing = runs.with_originals(suppliers.select("s_suppkey", F.expr(_ARCHIVED).alias("path")), originals, "path")
    return found.select("s_suppkey", "path", "original", F.lit(False).alias("missing")).union(missing.select("s_suppkey", "path", F.lit(None).cast("string"), F.lit(True)))
