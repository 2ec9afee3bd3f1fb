"""Codes of vectors against rounds over all entries in Python's integers."""

import hashlib
import math

import numpy as np

from ledgerloom.llm import quantise
from ledgerloom.llm.quantise import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=4):
    kept = [(v, [math.floor(1024 * x) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 4
    parts = lambda e: [e[k * d : k * d + d] for k in range(4)]
    books = [[parts(e)[k] for _, e, _ in kept[:256]] for k in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, book: min((dist(p, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for k in range(4):
            took = {}
            for _, e, _ in kept:
                took.setdefault(near(parts(e)[k], books[k])[1], []).append(parts(e)[k])
            new.append([[sum(c) // len(took[j]) for c in zip(*took[j])] if j in took else old for j, old in enumerate(books[k])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], {}
    for v, e, lab in kept:
        found = [near(p, b) for p, b in zip(parts(e), books)]
        out.append((v, "".join(f"{j:02x}" for _, j in found), sum(x for x, _ in found), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    return sorted(((v, c, err, by_label[lab], sha) for v, c, err, lab in out), key=str)


def got(spark, rows, parts=3, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as code", "1 as near", "cast(null as string) as error").repartition(parts)
    return sorted((tuple(r) for r in vector_codes(df).collect()), key=str)


def vectors(rng, n, d, far=()):
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, d))).astype(np.float32)
    x[rng.integers(0, n, n // 4)] = x[0]  # copies: ties everywhere
    rows = [(int(v), x[k].tolist(), [None, 1, 2][int(rng.integers(0, 3))]) for k, v in enumerate(rng.permutation(n))]
    return rows + list(far)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 420, 8, [(7, None, 1), (8, [1.0, None] * 4, 1), (9, [math.nan] * 8, None), (10, [math.inf] + [0.0] * 7, 2), (None, [0.5] * 8, 5), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (1000, [0.0] * 8, None)])
    assert got(spark, rows) == brute(rows)


def test_coarse_numbers_tie_often(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), i % 3) for i in range(700)]
    assert got(spark, rows) == brute(rows)


def test_few_and_huge_and_odd_lengths(spark):
    big, most = float(np.float32(1e30)), float(np.float32(3.4e38))
    rows = [(5, [big, -big, 1.0, 2.0], 1), (2, [most, 0.0, -most, 1.0], 1), (9, [1.0, 1.0, 1.0, 1.5], None)]
    assert got(spark, rows) == brute(rows)
    many = [(i, [float(i % 7), big, 0.0, 1.0], 1) for i in range(300)]
    assert got(spark, many) == brute(many)
    mixed = rows + [(1, [], 7), (4, [1.0, 2.0, 3.0, 4.0, 5.0], 7), (6, [], None)]
    assert {r[0]: (r[1], r[2]) for r in got(spark, mixed) if r[0] in (1, 4, 6)} == {1: ("00000000", 0), 4: ("00000000", 0), 6: ("00000000", 0)}
    assert got(spark, []) == got(spark, [(1, None, 1)]) == []
    assert vector_codes(spark.createDataFrame([(1, [1.0] * 4)], "vec_id long, embedding array<double>")).first()[:4] == (1, "00000000", 0, 0)


def test_bounds_never_hide_the_nearest():
    """Bounds shifted over many moves: always what a search over all entries finds, and entries are in fact left out."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, (500, 4))
    entries = x[:64].copy()
    near, upper, lower = np.zeros(500, np.int64), np.full(500, np.inf), np.zeros((500, 64))
    book, asked = quantise.Codebook(entries), []
    plain = quantise.squared
    for _ in range(8):
        quantise.squared = lambda a, b: asked.append(len(a)) or plain(a, b)
        try:
            error = book.assign(x, near, upper, lower)
        finally:
            quantise.squared = plain
        every = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
        assert (near == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
        moved = book.entries + rng.integers(-20, 21, book.entries.shape)
        book = quantise.Codebook(moved, book.entries)
    assert asked[0] == 500 * 64 and max(asked[1:]) < 500 * 64 / 3
