import random

import numpy as np

from ledgerloom.llm.jaccard import DEPTHS, enough, recall, signatures, similar_documents


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (links[i], low[find(i)]) for i in range(n)}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    base = []
    for d in range(300):
        if d % 3 or not base:
            w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([2, 4, 6, 40, 150]))]
            base.append(w)
        else:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((1000 - d, " ".join(w)))
    hot = [f"h{i}" for i in range(150)]
    for d in range(400):
        w = list(hot)
        w[rng.randrange(150)] = f"y{rng.randrange(60)}"
        rows.append((2000 + d, " ".join(w)))
    rows += [(5000 + i, hot_text) for i, hot_text in enumerate([" ".join(hot)] * 5 + ["", None, " \n", "a b", "a  b"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'k' as keys").repartition(4)
    got = {r.doc_id: (r.n_links, r.group_id) for r in similar_documents(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[d][0] <= want[d][0] for d in want)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())
    assert sum(got[d][1] == want[d][1] for d in want) >= 0.99 * len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.group_id, r.kept) for r in similar_documents(df).collect()), key=str)
    assert got == [(2, 2, 1, 2, True), (2, 2, 1, 2, True), (3, 3, 0, 3, True), (None, None, 0, None, True)]
    assert similar_documents(df.limit(0)).count() == 0


def test_links_at_the_threshold(spark):
    # of 81 shingles 9 are exchanged: similarity 72 / 90
    rng = random.Random(5)
    rows = []
    for d in range(1500):
        w = [f"w{rng.randrange(10**6)}" for _ in range(85)]
        v = list(w)
        v[40:45] = [f"x{rng.randrange(10**6)}" for _ in range(5)]
        rows += [(2 * d, " ".join(w)), (2 * d + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert similar_documents(df).filter("n_links = 1").count() >= 0.995 * len(rows)


def test_signatures_of_very_long_texts_differ():
    rng = np.random.default_rng(2)
    n = 150_000
    h = rng.integers(0, 1 << 63, 4 * n, dtype=np.uint64)
    keys = signatures(h, np.full(4, n))
    for a in range(4):
        for b in range(a):
            assert (keys[a] == keys[b]).mean() < 0.02


def test_prefixes_are_shortened_by_what_was_found():
    assert recall(0.8, DEPTHS[-1]) > 0.999
    assert not enough([0, 0, 0, 0], DEPTHS[0]) and enough([0, 0, 0, 0], DEPTHS[-1])
    assert enough([10, 100, 1000, 10_000], 8)
    assert not enough([10_000, 10, 10, 10], 8) and enough([10_000, 10, 10, 10], 6)
