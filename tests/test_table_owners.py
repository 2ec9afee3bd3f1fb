"""Rows of cells and owners of lines against plain Python."""

import random
import re

from ledgerloom.operators import table_owners

BOX = "page_id long, {} long, x1 double, y1 double, x2 double, y2 double"


def rows_by_hand(cells):
    rows = []
    for x in sorted(cells, key=lambda s: (s[2], s[1], s[0])):
        rid, x1, y1, x2, y2 = x
        h, cy = max(1, y2 - y1), (y1 + y2) / 2
        best = None
        for i, r in enumerate(rows):
            d = (abs(y1 - r["y1"]), abs(y2 - r["y2"]), abs(cy - r["cy"]), abs(h - r["h"]))
            if d[0] <= 4 and d[1] <= 4 or d[2] <= 4 and d[3] <= 6:
                key = (d[0] + d[1], d[2], d[3], abs(x1 - r["left"]), i)
                best = min(best, key) if best else key
        if best:
            r, n = rows[best[4]], len(rows[best[4]]["cells"])
            for f, v in (("y1", y1), ("y2", y2), ("cy", cy), ("h", h)):
                r[f] = (r[f] * n + v) / (n + 1)
            r["left"] = min(r["left"], x1)
            r["cells"].append(x)
        else:
            rows.append({"y1": y1, "y2": y2, "cy": cy, "h": h, "left": x1, "cells": [x]})
    return [r["cells"] for r in rows]


def shared(a, b, c, d):
    return max(0, min(b, d) - max(a, c))


def parts_by_hand(line, rows):
    item, x1, y1, x2, y2, text = line
    mid, hits = (y1 + y2) / 2, []
    for i, cells in enumerate(rows):
        top, bottom = min(s[2] for s in cells), max(s[4] for s in cells)
        if shared(y1, y2, top, bottom) > 0:
            hits.append(((top <= mid <= bottom, shared(y1, y2, top, bottom), -abs((top + bottom) / 2 - mid), -i), i))
    if not hits:
        return []
    met = sorted((s for s in rows[max(hits)[1]] if shared(x1, x2, s[1], s[3]) > 0), key=lambda s: (s[1], s[0]))
    m = re.match(r"(\d+[.,]\d{2})\s+(.+)", text)
    if len(met) == 2 and m and met[0][3] - met[0][1] <= 160 and met[1][3] - met[1][1] >= 250 and met[1][1] > met[0][1]:
        return [(item, met[0][0], m[1]), (item, met[1][0], m[2])]
    return [(item, max(met, key=lambda s: (shared(x1, x2, s[1], s[3]), -s[1], -s[0]))[0], text)] if met else []


def page(rng, wild):
    cells, lines = [], []
    for r in range(rng.randrange(1, 7)):
        x = rng.randrange(0, 30)
        for k in range(rng.randrange(1, 5)):
            w = rng.choice([60, 140, 260, 400])
            y = r * 40 + rng.randrange(0, 12 if wild else 3)
            cells.append((len(cells) + 1, float(x), float(y), float(x + w), float(y + rng.choice([30, 33, 36]))))
            x += w
    for k in range(rng.randrange(1, 12)):
        x, y = rng.randrange(0, 600), rng.randrange(0, 280)
        lines.append((k, float(x), float(y), float(x + rng.randrange(1, 400)), float(y + rng.randrange(1, 40)), rng.choice(["12,50 краска белая", "слово", "3.00 x", "12,5 нет"])))
    return cells, lines


def test_rows_and_parts(spark):
    rng = random.Random(3)
    pages = {p: page(rng, p % 2) for p in range(120)}
    cells = spark.createDataFrame([(p, *s) for p, (cs, _) in pages.items() for s in cs], BOX.format("region_id")).repartition(3)
    lines = spark.createDataFrame([(p, *s) for p, (_, ls) in pages.items() for s in ls], BOX.format("item_id") + ", text string").repartition(3)
    want = {p: rows_by_hand(cs) for p, (cs, _) in pages.items()}
    got = {}
    for r in table_owners.table_rows(cells).collect():
        got.setdefault((r.page_id, r.row_no), set()).add(r.region_id)
    assert got == {(p, i): {s[0] for s in cs} for p, rows in want.items() for i, cs in enumerate(rows)}
    have = sorted(tuple(r) for r in table_owners.cell_parts(lines, cells).collect())
    assert have == sorted((p, *x) for p, (_, ls) in pages.items() for s in ls for x in parts_by_hand(s, want[p]))
    plan = table_owners.cell_parts(lines, cells)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert table_owners.cell_parts(lines.limit(0), cells).count() == table_owners.cell_parts(lines, cells.limit(0)).count() == 0


def test_name_column(spark):
    cells = [(1, r * 10 + k, x, float(r * 40), x + w, float(r * 40 + 38)) for r in range(5) for k, (x, w) in enumerate(((0.0, 100.0 if r == 4 else 200.0), (200.0, 100.0)))]
    items = [(1, 1, 5.0, 82.0, 150.0, 156.0, "Краска<br/>белая <b>для</b> дома\n\nмалая"), (1, 2, 5.0, 10.0, 90.0, 20.0, "шапка"), (1, 3, 250.0, 90.0, 290.0, 100.0, "цена"), (1, 4, 5.0, 165.0, 90.0, 175.0, "узкая"), (1, 5, 5.0, 84.0, 9.0, 86.0, None)]
    got = {r.region_id: r.texts for r in table_owners.name_column(spark.createDataFrame(items, BOX.format("item_id") + ", text string"), spark.createDataFrame(cells, BOX.format("region_id"))).collect()}
    assert got == {20: ["Краска"], 30: ["белая для дома", "малая"]}
    lines = table_owners.visual_lines(spark.createDataFrame(items[:1], BOX.format("item_id") + ", text string")).collect()
    assert [(r.piece, r.y1, r.y2, r.text) for r in sorted(lines)] == [(0, 82.0, 82 + 74 / 3, "Краска"), (1, 82 + 74 / 3, 82 + 74 / 3 * 2, "белая для дома"), (2, 82 + 74 / 3 * 2, 156.0, "малая")]


def test_rows_are_found_once_whatever_the_heights(spark):
    rng = random.Random(11)
    pages = {}
    for p in range(60):
        # dense and gapped pages; some hold thin or upside-down cells, which no gap parts from rows above
        step, low = rng.choice([2, 5, 9, 30]), p % 3 == 0
        pages[p] = [(k, float(rng.randrange(0, 300)), y := k // 3 * step + rng.random() * rng.choice([1, 5]), 400.0, y + (rng.choice([-9, 0, 0.5, 14]) if low else rng.choice([1, 12, 14, 15]))) for k in range(40)]
    cells = spark.createDataFrame([(p, *s) for p, cs in pages.items() for s in cs], BOX.format("region_id")).repartition(3)
    got = {}
    for r in table_owners.table_rows(cells).collect():
        got.setdefault((r.page_id, r.row_no), [set(), r.top, r.bottom])[0].add(r.region_id)
    want = {(p, i): [{s[0] for s in cs}, min(s[2] for s in cs), max(s[4] for s in cs)] for p, own in pages.items() for i, cs in enumerate(rows_by_hand(own))}
    assert got == want
    missing = spark.createDataFrame([(1, 1, 0.0, None, 9.0, 9.0), (1, 2, 0.0, float("nan"), 9.0, 9.0), (1, 3, None, 1.0, 9.0, 9.0), (1, 4, 0.0, 1.0, 9.0, 9.0)], BOX.format("region_id"))
    assert sorted((r.region_id, r.row_no, r.top, r.bottom) for r in table_owners.table_rows(missing).collect()) == [(1, 0, None, 9.0), (2, 1, None, 9.0), (3, 2, 1.0, 9.0), (4, 2, 1.0, 9.0)]
    lines = cells.selectExpr("page_id", "region_id as item_id", "x1", "y1", "x2", "y2", "'a' as text")
    plan = table_owners.cell_parts(lines, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
