"""Repeated rows, very long texts, nulls in further columns and clashing names, for operators without such tests of their own."""

import random

import public_tokenizers

from ledgerloom.llm import decontam, jaccard, packing, substring

LONG = " ".join(f"w{random.Random(1).randrange(10**6)}{k}" for k in range(60_000))


def frame(spark, rows, *more):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *more).repartition(3)


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank today"
    items = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string").selectExpr("*", "cast(null as string) as pos")
    docs = frame(spark, [(1, f"{LONG} {item}"), (1, f"{LONG} {item}"), (2, LONG), (3, None)], "'x' as item_id", "cast(null as int) as h")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(1, 1)]


def test_jaccard(spark):
    docs = frame(spark, [(1, LONG), (2, f"{LONG} more"), (3, f"{LONG} more"), (4, "a b"), (5, "a b")], "'x' as cls", "7 as grams", "cast(null as int) as packed")
    got = {r.doc_id: (r.n_links, r.group_id, r.kept) for r in jaccard.similar_documents(docs).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False)}


def test_substrings(spark):
    docs = frame(spark, [(1, LONG), (2, f"own words {LONG}"), (3, None), (None, LONG)], "'x' as key", "1 as doc", "cast(null as binary) as hits")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.removed_words(docs).collect()}
    assert got == {1: (60_000, 0), 2: (60_002, 60_000), 3: (0, 0), None: (60_000, 0)}


def test_packing(spark):
    docs = frame(spark, [(1, LONG), (2, "short"), (2, "short"), (3, None)], "'x' as chunk", "1 as start", "cast(null as binary) as ids")
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    whole = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == whole[1] + 2 * whole[2] + 1 and whole[3] == 1
