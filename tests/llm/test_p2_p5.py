from pyspark.sql import functions as F

from folioscope.llm import p2, p5


def test_same_as_spellings(spark):
    rel = spark.createDataFrame([("w", "C02", "c1 ", "SameAs"), ("w", "C3", "C02", "same-as"), ("w", "C4", "C5", "not_same_as"), ("w", "C6", "Cxx", "same_as"), ("w", "C7", None, "same as"), ("w", "?", "C8", "same_as"), ("v", "C1", "C9", "same_as"), (None, "C1", "C2", "same_as"), ("w", "C9", "C9", "same_as")], "_id string, a string, b string, type string")
    chars = spark.createDataFrame([("w", f"C0{i}") for i in range(1, 9)] + [("w", None)], "_id string, id string")
    out = {(r._id, r.member): r.root for r in p2.same_as_groups(rel, chars).collect()}
    assert {k: v for k, v in out.items() if k[1] != v} == {("w", 2): 1, ("w", 3): 1, ("v", 9): 1}
    assert {("w", i) for i in range(1, 10)} | {("v", 1), ("v", 9)} == set(out)


def test_headings(spark):
    df = spark.createDataFrame([("A, B; anon. ;a, b",), (None,), ("",), (" Anonymous",), ("12;--",)], "a string")
    assert [r[0] for r in df.select(p5.headings(F.col("a"))).collect()] == [["a, b"], [], [], [], []]


def test_related_and_clashing_columns(spark):
    df = spark.createDataFrame([("b", ["x"], 1), ("a", ["x", "y"], 2), ("c", ["y"], 3), ("d", None, 4), ("e", [], 5), (None, ["x"], 6), ("a", ["x"], 7)], "id string, es array<string>, root int")
    assert {r.member: r.root for r in p5.related(df, "id", F.col("es")).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_splits_keep_groups_and_shares(spark):
    sizes = spark.createDataFrame([("hot", 3000)] + [(f"g{i}", 1 + i % 3) for i in range(3500)], "g string, n bigint")
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    out = p5.assign(sizes.repartition(5), "g", "n", shares)
    assert out.count() == 3501 and out.select("g").distinct().count() == 3501
    total = 3000 + sum(1 + i % 3 for i in range(3500))
    for r in out.groupBy("split").agg(F.sum("n").alias("n")).collect():
        assert abs(r.n / total - dict(shares)[r.split]) < 0.015
    assert [tuple(r) for r in out.orderBy("g").collect()] == [tuple(r) for r in p5.assign(sizes, "g", "n", shares).orderBy("g").collect()]
    assert p5.assign(sizes.limit(0), "g", "n", shares).count() == 0
