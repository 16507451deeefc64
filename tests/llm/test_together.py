import itertools
import random

import numpy as np

from folioscope.llm import p6


def baskets(spark, rows):
    return spark.createDataFrame([(r, 1) for r in rows], "basket array<string>, item_a int")


def test_counts_against_brute_force(spark):
    rng = random.Random(5)
    rows = [sorted({rng.choice("abcdefg") for _ in range(rng.randrange(0, 5))}) for _ in range(200)] + [None, []]
    want = {}
    for r in rows:
        for pair in itertools.combinations(r or [], 2):
            want[pair] = want.get(pair, 0) + 1
    got = {(r.item_a, r.item_b): r for r in p6.together(baskets(spark, rows)).collect()}
    assert {k: r.n_both for k, r in got.items()} == want
    n = sum(r is not None for r in rows)
    for (a, b), r in got.items():
        na, nb = (sum(x in (s or []) for s in rows) for x in (a, b))
        assert (r.n_a, r.n_b, r.records) == (na, nb, n) and abs(r.lift - r.n_both * n / (na * nb)) < 1e-9
    some = p6.together(baskets(spark, rows), least=20).collect()
    assert {(r.item_a, r.item_b): r.n_both for r in some} == {k: v for k, v in want.items() if v >= 20}
    assert all(abs(r.p_value - got[(r.item_a, r.item_b)].p_value) < 1e-12 for r in some)


def test_null_honours_frequencies_and_sizes():
    degrees, items = np.array([3.0, 10.0, 40.0]), np.array([5.0, 4.0, 2.0])
    sizes, records = np.array([1.0, 2.0, 4.0]), np.array([35.0, 30.0, 10.0])
    x, y = p6.fit_null(degrees, items, sizes, records)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * records).sum(1), degrees, rtol=1e-4) and np.allclose((p * items[:, None]).sum(0), sizes, rtol=1e-4)


def test_tails():
    rng = np.random.default_rng(1)
    q, n = np.array([0.02, 0.2]), np.array([120.0, 60.0])
    p = np.array([1.0])
    for c, m in zip(q, n.astype(int)):
        for _ in range(m):
            p = np.convolve(p, (1 - c, c))
    for k in range(0, 181):
        want = p[k:].sum()
        assert abs(p6.tail(q, n, k) - want) <= 1e-9 * want, k
    draws = rng.binomial(120, 0.02, 20000) + rng.binomial(60, 0.2, 20000)
    assert abs((draws >= 20).mean() - p6.tail(q, n, 20)) < 0.01
    assert p6.tail(q, n, 0) == 1.0 and p6.tail(q, n, 181) == 0.0
    # a binomial of a thousand million trials
    big = p6.tail(np.array([1e-3]), np.array([1e9]), 1_003_000)
    assert abs(big / 1.36e-3 - 1) < 0.02


def test_fitness_meets_its_frequency():
    y, records = np.array([0.01, 0.1, 2.0]), np.array([1000.0, 200.0, 10.0])
    for count in (1, 17, 400, 1200):
        x = p6.fitness(count, y, records)
        assert abs((records * x * y / (1 + x * y)).sum() - count) < 1e-6 * count


def test_long_baskets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(p6, "PART", 3)
    rows = [list("abcdefghij"), list("abc"), list("abcd"), ["a"], []]
    df = spark.createDataFrame([(r, i + 1) for i, r in enumerate(rows)], "b array<string>, w bigint")
    got = sorted((r.w, r.item_a, r.item_b) for r in p6._pairs_of(df).collect())
    assert got == sorted((i + 1, x, y) for i, r in enumerate(rows) for x, y in itertools.combinations(r, 2))


def test_labels_and_empty(spark):
    df = spark.createDataFrame([(1, ["Sea-Story", " sea story", None, ""]), (1, ["novel"]), (2, None), (3, [])], "k int, l array<string>")
    assert {r.k: r.basket for r in p6.baskets_of(df, ["k"], "l").collect()} == {1: ["novel", "seastory"], 3: []}
    assert {r.item: r.label for r in p6.written_forms(df, "l", "_").collect()} == {"seastory": "sea_story", "novel": "novel"}
    assert p6.together(baskets(spark, [])).count() == 0 and p6.together(baskets(spark, [["a"], ["b"]])).count() == 0
