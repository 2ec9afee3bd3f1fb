"""Boxes against plain Python on random pages."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import boxes

RNG = random.Random(5)
ITEMS = [(f"p{k % 6}", k, x, y, x + RNG.randint(20, 400), y + RNG.randint(4, 90), " ".join(f"w{j}" for j in range(RNG.randint(0, 9)))) for k in range(120) for x, y in [(RNG.randint(0, 600), RNG.randint(0, 500))]]
REGIONS = [(f"p{k % 6}", k, x, y, x + RNG.randint(30, 300), y + RNG.randint(10, 200)) for k in range(60) for x, y in [(RNG.randint(0, 600), RNG.randint(0, 500))]]


@pytest.fixture(scope="module")
def pages(spark):
    items = spark.createDataFrame(ITEMS, "page_id string, item_id int, x1 int, y1 int, x2 int, y2 int, text string")
    return items, spark.createDataFrame(REGIONS, "page_id string, region_id int, rx1 int, ry1 int, rx2 int, ry2 int")


def hits(item):
    page, _, x1, y1, x2, y2, _ = item
    return [r for r in REGIONS if r[0] == page and min(x2, r[4]) > max(x1, r[2]) and min(y2, r[5]) > max(y1, r[3])]


def dealt(words, parts, width):
    used, out = 0, []
    for i, (region, a, b) in enumerate(parts):
        take = round((b - a) / max(1, width) * len(words))
        chunk = words[used:] if i == len(parts) - 1 else words[used : used + take]
        used += take
        if chunk:
            out.append((region, " ".join(chunk)))
    return out


def test_words_over_regions(pages):
    want = []
    for item in ITEMS:
        parts = [(r[1], max(item[2], r[2]), min(item[4], r[4])) for r in sorted(hits(item), key=lambda r: (r[2], r[1]))]
        want += [(item[0], item[1], *part) for part in dealt(item[6].split(), parts, item[4] - item[2])]
    assert sorted(map(tuple, boxes.split_over_regions(*pages).collect())) == sorted(want)


def test_words_over_smallest_regions(pages):
    want = []
    for item in ITEMS:
        found = hits(item)
        edges = sorted({e for r in found for e in (max(item[2], r[2]), min(item[4], r[4]))})
        parts = []
        for a, b in zip(edges, edges[1:]):
            over = [((r[4] - r[2]) * (r[5] - r[3]), r[2], r[3], r[1]) for r in found if max(item[2], r[2]) <= a and min(item[4], r[4]) >= b]
            if over:
                owner = min(over)[3]
                if parts and parts[-1][0] == owner and parts[-1][2] == a:
                    parts[-1] = (owner, parts[-1][1], b)
                else:
                    parts.append((owner, a, b))
        want += [(item[0], item[1], *part) for part in dealt(item[6].split(), parts, item[4] - item[2])]
    assert sorted(map(tuple, boxes.split_over_smallest(*pages).collect())) == sorted(want)


def test_owner_text_and_neighbours(pages):
    items, regions = pages
    owners = {(r.page_id, r.item_id): r.region_id for r in boxes.best_region(items, regions).collect()}
    right = {(r.page_id, r.item_id): r.right_id for r in boxes.right_neighbours(items, 200).collect()}
    below = {(r.page_id, r.item_id): r.below_id for r in boxes.below_neighbours(items, 150).collect()}
    for item in ITEMS:
        page, n, x1, y1, x2, y2, _ = item
        cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
        score = lambda r: (r[2] <= cx < r[4] and r[3] <= cy < r[5], min(y2, r[5]) - max(y1, r[3]), -abs(cy - (r[3] + r[5]) / 2), min(x2, r[4]) - max(x1, r[2]), -r[1])
        assert owners.get((page, n)) == max(((score(r), r[1]) for r in hits(item)), default=(0, None))[1]
        shared = lambda a1, a2, b1, b2: min(a2, b2) - max(a1, b1)
        near = [(o[2] - x2, abs(y1 - o[3]), o[1]) for o in ITEMS if o[0] == page and o[1] != n and 0 <= o[2] - x2 <= 200 and 0 < shared(y1, y2, o[3], o[5]) >= 0.35 * min(y2 - y1, o[5] - o[3])]
        assert right.get((page, n)) == min(near, default=(0, 0, None))[2]
        near = [(o[3] - y2, abs(x1 - o[2]), o[1]) for o in ITEMS if o[0] == page and o[1] != n and 0 <= o[3] - y2 <= 150 and 0 < shared(x1, x2, o[2], o[4]) >= 0.35 * min(x2 - x1, o[4] - o[2])]
        assert below.get((page, n)) == min(near, default=(0, 0, None))[2]
    texts = boxes.region_text(items, regions).collect()
    assert len(texts) == len(REGIONS)
    for r in texts:
        region = next(x for x in REGIONS if x[1] == r.region_id)
        assert r.text == " ".join(i[6] for i in sorted((i for i in ITEMS if region in hits(i)), key=lambda i: (i[3], i[2], i[1])))


def banded(cells, tolerance, by_top):
    rows = []
    for c in sorted(cells, key=lambda c: (c[1], c[0])) if by_top else cells:
        y = c[1] if by_top else (c[1] + c[3]) / 2
        for row in rows:
            if abs(row[0] - y) <= tolerance:
                row[0] = (row[0] * len(row[1]) + y) / (len(row[1]) + 1)
                row[1].append(c)
                break
        else:
            rows.append([y, [c]])
    return [[c[4] for c in sorted(cs, key=lambda c: c[0])] for _, cs in (rows if by_top else sorted(rows, key=lambda r: r[0]))]


@pytest.mark.parametrize("by_top", [True, False])
def test_bands(spark, by_top):
    rng = random.Random(8)
    data = [(n, [(x, y, x + 30, y + rng.randint(5, 30), f"c{k}") for k in range(n * 7) for x, y in [(rng.randint(0, 60), rng.randint(0, 120))]]) for n in range(8)]
    df = spark.createDataFrame(data, "n int, cells array<struct<x1 int, y1 int, x2 int, y2 int, text string>>")
    rows = df.select("n", boxes.bands(F.col("cells"), 10, by_top).alias("rows")).select("n", F.transform("rows", lambda r: F.transform(r, lambda c: c.text)).alias("t"), boxes.row_texts(F.col("rows")).alias("lines")).collect()
    cells = dict(data)
    for r in rows:
        assert r.t == banded(cells[r.n], 10, by_top)
        assert r.lines == [" | ".join(t) for t in r.t]


def test_boxes_in_arrays_and_columns(spark):
    kept = spark.sql("SELECT array(array(1,1,9,9), array(3,2,10,9), array(6,4,12,11), array(50,1,60,9)) AS b").select(boxes.distinct_boxes(F.col("b"))).first()[0]
    assert kept == [[1, 1, 9, 9], [6, 4, 12, 11], [50, 1, 60, 9]]
    zone = spark.sql("SELECT array(struct(0 AS y1, 10 AS y2, 'a' AS text), struct(8 AS y1, 12 AS y2, 'b  c' AS text)) AS s").select(boxes.zone_text(F.col("s"), F.lit(5), F.lit(11))).first()[0]
    assert zone == "a b c"
    values = spark.createDataFrame([("k", v) for v in (1, 1, 3, 20, 22, 60)], "k string, v int")
    assert sorted(map(tuple, boxes.gap_centres(values, "k", "v", 5).select("centre", "n").collect())) == [(5 / 3, 3), (21.0, 2), (60.0, 1)]


def test_pairs_are_dealt_by_line_before_one_is_chosen(spark):
    lines = spark.createDataFrame([(p, i, i * 10, 0, i * 10 + 15, 20, "a") for p in range(3) for i in range(4)], "page_id long, item_id int, x1 int, y1 int, x2 int, y2 int, text string")
    regions = spark.createDataFrame([(p, r, r * 20, 0, r * 20 + 20, 40) for p in range(3) for r in range(3)], "page_id long, region_id int, rx1 int, ry1 int, rx2 int, ry2 int")
    owners = boxes.best_region(lines, regions)
    assert sorted(map(tuple, owners.collect())) == sorted((p, i, r) for p in range(3) for i, r in enumerate((0, 0, 1, 1)))
    for df in (owners, boxes.right_neighbours(lines, 50)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan.split("Join")[0]
