"""Links of vectors against all cosines, where near copies are the majority, few, or of a rare length."""

import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import embed


def near(rng, centre, n, cosine):
    """Vectors at a cosine to a centre, in random directions."""
    c = centre / np.linalg.norm(centre)
    away = rng.normal(size=(n, len(c)))
    away -= (away @ c)[:, None] * c
    return cosine * c + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)


def check(spark, groups, least=0.97):
    """groups: arrays of vectors, each of a length of its own or not."""
    vectors = [v for g in groups for v in g]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(df).collect()}
    want = np.zeros(len(vectors), np.int64)
    for d in {len(v) for v in vectors}:
        ids = [i for i, v in enumerate(vectors) if len(v) == d]
        x = np.array([vectors[i] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want[ids] = (x @ x.T >= 0.95).sum(1) - 1
    have = np.array([got[i][0] for i in range(len(vectors))])
    assert (have <= want).all() and want.sum() > 0
    assert have.sum() >= least * want.sum(), (have.sum(), want.sum())
    return got, want


@pytest.mark.parametrize("few", [embed.FEW, 0])
def test_near_copies_in_the_majority(spark, monkeypatch, few):
    """Compared one with all, and by codes as if there were many."""
    monkeypatch.setattr(embed, "FEW", few)
    rng = np.random.default_rng(1)
    for n, rest in ((1200, 800), (60, 20), (600, 1400)):
        check(spark, [near(rng, rng.normal(size=64), n, 0.985), rng.normal(size=(rest, 64))])


@pytest.mark.parametrize("few", [embed.FEW, 0])
def test_few_vectors_and_rare_lengths(spark, monkeypatch, few):
    monkeypatch.setattr(embed, "FEW", few)
    rng = np.random.default_rng(2)
    least = 0.9 if few else 0.0  # of one pair or none that codes may miss
    pair = near(rng, rng.normal(size=32), 2, 0.995)
    got, want = check(spark, [pair], least)
    assert not few or got[0] == got[1] == (1, 0)
    check(spark, [near(rng, np.eye(16)[0], 300, 0.985), rng.normal(size=(100, 16))])
    check(spark, [rng.normal(size=(100, 64)), near(rng, rng.normal(size=48), 2, 0.99), near(rng, rng.normal(size=64), 5, 0.985), near(rng, np.eye(7)[2], 40, 0.985)])


def test_strong_mean_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(embed, "FEW", 100)
    rng = np.random.default_rng(3)
    shift = 2 * rng.normal(size=64)
    groups = [near(rng, shift + rng.normal(size=64), 6, 0.98) for _ in range(150)]
    check(spark, [shift + rng.normal(size=(1500, 64)), *groups])


def test_cuts_never_part_a_row_from_its_partner():
    rng = np.random.default_rng(4)
    for x in (near(rng, rng.normal(size=64), 500, 0.99), np.concatenate([near(rng, rng.normal(size=64), 700, 0.985), rng.normal(size=(300, 64))]), rng.normal(size=(800, 64)), np.eye(64)[:5]):
        x = embed.unit(x)
        turn, cut = embed.learn_rotations(x, 2)
        y = embed._partners(x, 0.95, rng)
        parted = ((x @ turn > cut) != (y @ turn > cut)).mean(axis=1)
        assert parted.mean() < 0.14 and parted.max() < 0.35
    assert len(embed.thinned(embed.unit(near(rng, rng.normal(size=64), 500, 0.99)))) == 1


def test_memory_of_learning():
    """The rows that rotations are learned from are compared block by block: no table of all with all."""
    x = embed.unit(np.random.default_rng(3).normal(size=(12_000, 8)))
    tracemalloc.start()
    kept = embed.thinned(x, 0.999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) > 8_000 and peak < 40 << 20
    small = x[:3_000]
    slow = small[:0]
    for row in small:
        if not len(slow) or (slow @ row < 0.999).all():
            slow = np.concatenate([slow, row[None]])
    assert np.array_equal(embed.thinned(small, 0.999, 500), slow)


def test_nothing_large_is_broadcast(spark):
    """Joins of tables that grow with the input pass nothing through the driver, however small their files look."""
    x = np.random.default_rng(4).normal(size=(60, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, x * 2, x + 1e-3]))], "vec_id long, embedding array<double>")
    out = embed.near_vectors(rows)
    assert out.filter("n_links > 0").count() == 180 and "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
