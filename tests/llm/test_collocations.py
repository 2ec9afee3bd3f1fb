"""Collocations against counts in plain Python."""

import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import collocations, queries
from ledgerloom.llm.collocations import phrases

SF = "/root/testdata/sf0.01"


def brute(rows, most=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = Counter()
    for (lang, *w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[(lang, *w[i : i + m])] = max(covered[(lang, *w[i : i + m])], a)
    out = []
    for p, a in cand.items():
        lang, *w = p
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        if not (p in covered and 100 * covered[p] >= share * a):
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    got, at = [], Counter()
    for lang, score, a, w, l, r in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            got.append((lang, at[lang], w.decode(), -a, l, r, n[lang], -score))
    return sorted(got)


def got(df, **how):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases(df, **how).collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["The", "the", "of", "É", "é", "a\x1cb", "\xa0", "x\x85", "🙂"]
    joints = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "! ", "?:", "\x0b", "\x0c"]
    rows = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice(["", " "]) + t + rng.choice(["", " New York City", " new york", " . rare pair"])))
    return rows + [("en", None), ("fr", ""), ("fr", " . , "), ("es", "one two"), ("en", "a b " * 500), ("en", "a b " * 500)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'x' as word", "cast(null as int) as codes").repartition(parts)


def test_against_brute_force(spark):
    rows = texts(1, 400)
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, rows), most_words=5, least=4, share=70, top=30) == brute(rows, 5, 4, 70, 30)


def test_small_blocks_and_filters(spark, monkeypatch):
    """Counts that fall into many blocks and tasks, and a filter that lets nearly everything through."""
    rows = texts(2, 200)
    df = frame(spark, rows)
    monkeypatch.setattr(collocations, "GATHER_TOKENS", 300)
    monkeypatch.setattr(collocations, "GATHER_WORDS", 20)
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 7)
    assert got(df) == brute(rows)


def test_query_and_odd_tables(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    have = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in queries.op12_collocations(spark, SF).collect())
    assert have == brute(rows) and len(have) > 1000
    empty = spark.createDataFrame([], "lang string, text string")
    assert got(empty) == got(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")) == []


@pytest.mark.parametrize("end", [". ", " "])
def test_long_text(spark, end):
    rng = random.Random(3)
    rows = [("en", "".join(f"w{rng.randrange(300)}" + (end if k % 9 == 0 else " ") for k in range(200_000)))]
    assert got(frame(spark, rows)) == brute(rows)
