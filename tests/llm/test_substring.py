import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm import substring
from ledgerloom.llm.substring import removed_words


def brute(rows):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [8, 1, 2])
def test_against_brute_force(spark, monkeypatch, width):
    """Also with hashes so short that very many different windows share one."""
    monkeypatch.setattr(substring, "WINDOW_BYTES", width)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(120):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            a = rng.randrange(50)
            k = rng.randrange(len(w) + 1)
            w[k:k] = passage[a : a + rng.randrange(5, 40)]
        rows.append((d * 7 % 120, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (600, ""), (601, None), (602, "a b c \x1cd \x85"), (603, "the " * 500), (604, "the " * 300)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).selectExpr("doc_id", "text", "'x' as n_words", "1 as hits").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed_words(df).collect()}
    assert got == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in removed_words(df).collect()), key=str)
    assert got == [(1, 30, 0), (1, 30, 0), (2, 0, 0), (2, 30, 30), (None, 30, 0)]
    assert removed_words(df.limit(0)).count() == 0


def test_repeats_are_maximal():
    """Windows in a row that stand in a row in one other text are one repeat."""
    found = substring.repeats(np.array([3, 4, 5, 6, 9, 10, 20]), np.array([7, 7, 7, 8, 8, 8, 8]), np.array([30, 31, 32, 33, 40, 42, 1]))
    assert list(found) == [(3, 15, 7, 30), (6, 13, 8, 33), (9, 13, 8, 40), (10, 13, 8, 42), (20, 13, 8, 1)]


def test_equal_hashes_in_many_documents(spark, monkeypatch):
    """Windows share a byte of hash: the words alone decide, for hot passages as well."""
    monkeypatch.setattr(substring, "WINDOW_BYTES", 1)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(d, f"{'x ' * (d % 5)}{common if d % 2 else ''} {' '.join(f'u{d}_{i}' for i in range(20))} {common if d % 3 == 0 else ''}") for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed_words(df).collect()} == brute(rows)
