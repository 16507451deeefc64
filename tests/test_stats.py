import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from folioscope.operators import stats as T


def exact(a, b, c, d):
    n, r, k = a + b + c + d, a + b, a + c
    p = {x: Fraction(math.comb(k, x) * math.comb(n - k, r - x), math.comb(n, r)) for x in range(max(0, a - d), min(r, k) + 1)}
    return float(sum(v for v in p.values() if v <= p[a]))


def test_fisher_against_fractions(spark):
    rng = random.Random(3)
    tables = [tuple(rng.randrange(0, 40) for _ in range(4)) for _ in range(60)] + [(0, 5, 0, 5), (0, 0, 3, 4), (0, 0, 0, 0)]
    out = T.fisher(spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint")).collect()
    for r in out:
        assert math.isclose(r.p_value, exact(r.a, r.b, r.c, r.d), rel_tol=1e-6)


def test_fisher_of_large_tables():
    assert math.isclose(T.exact_p(3_050, 2_950, 3_000, 3_000), exact(3_050, 2_950, 3_000, 3_000), rel_tol=1e-9)
    assert T.exact_p(900, 10, 20, 5000) < 1e-300
    assert math.isclose(T.exact_p(700, 2, 3, 800), exact(700, 2, 3, 800), rel_tol=1e-6)
    big = 2_000_000_000
    assert math.isclose(T.exact_p(big, big, big, big), 1.0, rel_tol=1e-6)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.04, None, 0.9]
    out = {r.i: r.q for r in T.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").select("i", F.col("q_value").alias("q")).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    best = 1.0
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        best = min(best, x * len(known) / rank)
        assert math.isclose(out[i], best)
    assert out[4] is None


def test_contingency_keeps_empty_cells(spark):
    f = spark.createDataFrame([(i, "x") for i in range(4)] + [(i, "y") for i in range(4, 8)], "k int, feature string")
    g = spark.createDataFrame([(i, "g", "t") for i in range(4)] + [(99, "g", "t")], "k int, grp string, kind string")
    out = {r.feature: (r.a, r.b, r.c, r.d) for r in T.contingency(f, g.unionByName(spark.createDataFrame([(i, "h", "t") for i in range(4, 8)], "k int, grp string, kind string")), ["k"], 1, 1).filter("grp = 'g'").collect()}
    assert out == {"x": (4, 0, 0, 4), "y": (0, 4, 4, 0)}


def test_groups_prune_by_support(spark):
    tags = spark.createDataFrame([(i, t) for i in range(4) for t in ("a", "b")] + [(9, "rare")], "k int, tag string")
    texts = spark.createDataFrame([(i, 1720) for i in range(4)] + [(9, None)], "k int, year int")
    out = {(r.grp, r.kind) for r in T.groups(texts, tags, "k", F.col("year"), "tag", 3).collect()}
    assert out == {("a", "tag"), ("b", "tag"), ("a+b", "tag_pair"), ("1700-1749", "halfcent"), ("1700-1749|a", "halfcent_tag"), ("1700-1749|b", "halfcent_tag")}


def test_pairs_of_one_task_are_left_out(spark):
    f = spark.createDataFrame([(i, x) for i in range(3) for x in ("s.a", "s.b", "t.c")], "k int, feature string")
    assert {(r.feature_a, r.feature_b) for r in T.feature_pairs(f, ["k"], 1).collect()} == {("s.a", "t.c"), ("s.b", "t.c")}
    assert T.feature_pairs(f, ["k"], 1, across=False).count() == 3


def test_gini_and_residuals(spark):
    g = T.gini(spark.createDataFrame([("e", 1), ("e", 1), ("s", 0), ("s", 4), ("z", 0), ("o", 5)], "g string, v int"), ["g"], "v")
    assert {r.g: round(r.gini, 6) for r in g.collect()} == {"e": 0.0, "s": 0.5, "z": 0.0, "o": 0.0}
    line = spark.createDataFrame([("a", n, 2 * math.log1p(n) + 1) for n in range(1, 7)] + [("b", 1, 1.0)], "g string, n int, m double")
    for r in T.residualize(line, ["g"], "n", ["m"]).collect():
        assert r.m_resid is None if r.g == "b" else abs(r.m_resid) < 1e-9


def test_partition_of_variance(spark):
    rng = random.Random(1)
    rows = [(float(x), float(z), [3.0 * x + rng.gauss(0, 0.01), -x * 1.0]) for x in range(12) for z in (0, 1)]
    out = {r.grp: r for r in T.partition_r2(spark.createDataFrame(rows, "x double, z double, y array<double>"), "y", {"x": ["x"], "z": ["z"]}).collect()}
    assert out["x"].marginal_r2 > 0.999 and abs(out["z"].unique_r2) < 1e-3 and math.isclose(out["x"].full_r2, out["z"].full_r2)


def test_rates_keep_passages_without_flag(spark):
    facts = spark.createDataFrame([("t", "p", i, "f", v) for i, v in enumerate(["true", "yes", "no", "1"])] + [("t", "p", 0, "l", '["a"]')], "_id string, scheme string, seq int, field string, value string")
    texts = spark.createDataFrame([("t", "en", 1710)], "_id string, lang string, year int")
    flags = spark.createDataFrame([("t", "p", 0, "false"), ("t", "p", 1, "true"), ("t", "p", 1, "true")], "_id string, scheme string, seq int, flag string")
    spec = [{"field": "f", "element": None, "label": "f"}, {"field": "l", "element": "a", "label": "a"}]
    out = {r.label: (r.n, r.n_true, r.pct) for r in T.cross_language(facts, texts, spec, [1700, 1750], flags).collect()}
    assert out == {"f": (3, 2, 66.7)}
