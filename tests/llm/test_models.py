"""Operators with fitted models, and the pipeline, on the small tables."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, embed, license_scan, pii, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    y, s = np.asarray(y)[order], np.asarray(s)[order]
    rank = np.array([np.flatnonzero(s == v).mean() + 1 for v in s])
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    y = np.array([r.toxic for r in got])
    assert auc(y, [r.score for r in got]) > 0.95
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    empty = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, " . ", 7)], "doc_id long, text string, score int")
    assert [r.score for r in toxicity.score(empty, ({}, -3.0)).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.score(empty.limit(0), ({}, -3.0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 50_000 + "."), (2, "word " * 50_000 + ".")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(long, ({toxicity.features("word")[0]: 0.5}, -3.0)).collect()}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(empty, none) == ({}, -8.0)


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([(1, "A train from Paris travels 120 km in 2 hours to reach Berlin, so how fast does the train from Paris go?"), (2, None), (3, "short one"), (None, "x y z")], "item_id long, text string")
    docs = [
        (1, "noise words here A train from London travels 90 miles in 3 hours to reach Madrid, so how fast does the train from London go? more"),
        (2, "A train from London travels 90 miles in 3 hours to reach Madrid, so how fast does the train from Rome go?"),
        (3, "a train is fast and so is the road to reach"), (4, None), (5, ""), (None, "A train from Paris travels 120 km in 2 hours to reach Berlin, so how fast does the train from Paris go?"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as item_id")
    want = [(1, 1, 1.0)]
    got = decontam.contaminated(df, items)
    assert [(r.doc_id, r.item_id, r.coverage) for r in got.collect()] == want
    assert got.first().changed >= 3
    clean = spark.createDataFrame([(i, "nothing of the kind here at all") for i in range(50)] + docs[:1], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(clean, items).collect()] == [(1, 1)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    old, decontam.BROADCAST_WINDOWS = decontam.BROADCAST_WINDOWS, 0
    try:
        assert [(r.doc_id, r.item_id, r.coverage) for r in decontam.contaminated(df, items).collect()] == want
    finally:
        decontam.BROADCAST_WINDOWS = old
    assert decontam.contaminated(df.limit(0), items).count() == decontam.contaminated(df, items.limit(0)).count() == 0


def test_verbatim_copies_of_short_and_slot_heavy_items(spark):
    texts = ["Convert 5 km to miles.", "Who wrote Pride and Prejudice?", "Simplify 3 + 4 * 2", "Sort Oslo Rome Paris Bern Wien Prag Riga Kyiv Bonn Genf by the size of each one", "Define entropy", "two plus two"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, f"some words ({x}) - and more of them") for i, x in enumerate(texts)]
    rows += [(10, "Convert 7 km to miles."), (11, "Simplify 3 - 4 * 2 now"), (12, "Who wrote Emma and Prejudice?"), (13, "define the entropy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = decontam.BROADCAST_WINDOWS
    try:
        for decontam.BROADCAST_WINDOWS in (old, 0):
            got = sorted((r.doc_id, r.item_id, r.coverage, r.changed) for r in decontam.contaminated(docs, items).collect())
            assert got == [(i, i, 1.0, 0) for i in range(len(texts))]
    finally:
        decontam.BROADCAST_WINDOWS = old


def test_benchmark_passages_in_documents(spark):
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, SF).collect()}
    assert exact <= got
    assert len(got) <= 1.1 * len(exact) + 2


def test_vectors_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    bad = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [1.0] * 3), (9006, [float("inf")] + [1.0] * 63), (9007, list(rows[0].embedding)), (9008, [2 * x for x in rows[0].embedding])]
    df = spark.createDataFrame([(r.vec_id, list(r.embedding)) for r in rows] + bad, "vec_id long, embedding array<float>").repartition(3)
    more = [(9100, [1.0, 2.0]), (9101, [2.0, 4.0]), (9102, [1.0, 2.0]), (9103, [1.0, -2.0]), (9110, [1e-170, 2e-170, 0.0]), (9111, [1e170, 2e170, 0.0]), (9112, [0.0, 0.0, 1e170]), (None, [1.0, 2.0])]
    df = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "1 as id", "'c' as keys").union(spark.createDataFrame(more, "vec_id long, embedding array<double>").selectExpr("*", "1", "'c'"))
    got = {r.vec_id: r for r in embed.near_vectors(df).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in (9100, 9101, 9102, 9103, 9110, 9111, 9112)] == [(2, 9100), (2, 9100), (2, 9100), (0, 9103), (1, 9110), (1, 9110), (0, 9112)]
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    ids = [r.vec_id for r in rows] + [9007, 9008]
    x = np.array([r.embedding for r in rows] + [bad[6][1], bad[7][1]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert sum(got[i].n_links for i in ids) >= 0.97 * links.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, links))
    assert all((got[b].n_links, got[b].component_id, got[b].kept) == (0, b, True) for b in range(9001, 9007))
    assert embed.near_vectors(df.limit(0)).count() == 0


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


ODD = [
    "x@y.z%d@e.f a@b a@b.c.d. é@é.com 😀 me@x.org", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 4111 1111 1111 1111 99", "+1 (415) 555-0100 +49 30 1234567- +12 +1+2 555 123 4567 8",
    "Tel. (415) 555-0199 or 030 1234 5678, since 2020-01-05, kim (at) example (dot) org", "", None, "a" * 3000 + "@", "1" * 500 + " " + "1." * 300, "@.@ ++ --",
]


def test_pii_base_rules_and_additions(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as base")
    got = pii.find(df, pii.train(spark)).select("doc_id", pii.render(F.col("base")).alias("b"), pii.render(F.col("spans")).alias("s"), pii.redact(F.col("text"), F.col("spans")).alias("r")).collect()
    for r in got:
        assert r.b == base(texts[r.doc_id] or "")
        assert not r.b or set(r.b.split(",")) <= set(r.s.split(","))
    extra = [r for r in got if r.doc_id == 4][0]
    assert "phone:5:19" in extra.s and "email:" in extra.s and "2020-01-05" in extra.r
    assert [r for r in got if r.doc_id == 0][0].r == "<email><email> a@b <email>. é@é.com 😀 <email>"
    assert sum(r.b != r.s for r in got if r.doc_id >= len(ODD)) <= 30
    assert pii.find(df.limit(0), pii.Model((), (), {})).count() == 0


def test_pii_broad_candidates(spark):
    texts = {"host fe80::1 is up": "ip:5:12", "login from 2001:db8::7": "ip:11:22", "Tel. 4155550199": "phone:5:15", "phone 030/1234567": "phone:6:17", "credit card: 4111.1111.1111.1111": "card:13:32", "at 12:30:45 sharp": "", "order no 4155550199": "", "std::vector": "", "total 123456789": "", "ref 1234.5678.9012.3456": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.find(df, pii.train(spark)).select("text", pii.render(F.col("spans")).alias("s")).collect()
    assert {r.text: r.s for r in got} == texts


def test_pii_is_linear_in_matches(spark):
    """50,000 addresses in one text, and numbers that overlap; a quadratic form takes over an hour."""
    text = " ".join(f"é{i}@b{i}.org" if i % 5 else f"+49 30 {1000000 + i}" for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").repartition(2)
    model = pii.train(spark)
    began = time.time()
    for r in pii.find(df, model).select(pii.render(F.col("base")).alias("b"), pii.redact(F.col("text"), F.col("spans")).alias("r")).collect():
        assert r.b == base(text)
        assert r.r.count("<email>") == 40_000 and r.r.count("<phone>") == 10_000 and r.r.startswith("<phone> é<email>")
    assert time.time() - began < 120


def test_licences(spark):
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n */\nint x;"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os"
    lines = [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("some words here Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("his driving licence was revoked in May", ""), ("ordinary words", ""), (None, ""), ("", "")]
    # not among the templates: wrapped, in comments, in other words, and talk of licences that holds none
    lines += [(mit, "mit"), (gpl, "gpl"), ("The text of the pages is available under CC BY-SA 4.0 now.", "cc-by-sa"), ("You may use it, Distributed under the GNU GPL v3 or later.", "gpl")]
    lines += [(t, "") for t in ("The museum holds all rights to the copyright of the film.", "The fishing license costs five pounds in the north.", "Apache tribes lived in the west of the country.", "Permission to enter was granted by the guard.", "Copies of the licence hang in the office of the bar.", "word " * 30_000)]
    lines += [(t, "") for t in ("The book is distributed under the MIT press imprint.", "The license of MIT students was released under the old rule.", "Works by Apache authors are licensed to the museum.", "The public received a copy of the general plan.", "Permission is granted to visit the source of the river.", "He is a GNU herder and sells BSD shoes.", "CC the mail to Anna by 4 pm.")]
    lines += [("Licensed under the MIT license, terms apply.", "mit"), ("This file is distributed under the Apache License 2.0 as well.", "apache-2.0")]
    lines += [lines[0], lines[0]]
    df = spark.createDataFrame([(i, f"first line.\n{t}.\nlast" if t else t, 1) for i, (t, _) in enumerate(lines)], "doc_id long, text string, licences int")
    model = license_scan.train(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert 0.5 <= model.threshold <= 0.95 and model.recall > 0.7
    assert not {"and", "you", "under", "copy", "source", "person", "the"} & set(model.signs)
    texts = [p for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for p in (r.text or "").split("\n")]
    assert sum(bool(re.search(model.cue().replace("(?<![\\p{L}\\p{N}])", r"(?<!\w)").replace("(?![\\p{L}\\p{N}])", r"(?!\w)"), p)) for p in texts) < 0.08 * len(texts)
    for r in license_scan.scan(df, model).collect():
        assert ",".join(x.family for x in r.licences if x.confirmed) == lines[r.doc_id][1], lines[r.doc_id]
    assert license_scan.scan(df.limit(0), model).count() == 0


@pytest.mark.parametrize("rows", [0, 40])
def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.filter(f"doc_id < {rows * 10}") if t != "benchmark" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    n, before = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        before = after
    kept = before.count()
    assert kept <= n and kept >= 0.6 * n
    got = corpus_pipeline.pack(spark, before, str(tmp_path))
    assert got.select("doc_id").distinct().count() == kept
