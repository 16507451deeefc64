import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import segment as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, x string")


def test_fixed_windows(spark):
    out = S.fixed_windows(docs(spark, "a b c d e", "", None, "  one  "), "k", "x", 2).orderBy("k", "seq").collect()
    assert [(r.k, r.seq, r.text, r.n_words) for r in out] == [(0, 0, "a b", 2), (0, 1, "c d", 2), (0, 2, "e", 1), (3, 0, "one", 1)]


@pytest.mark.parametrize(("strategy", "count", "expected"), [("even", 3, [0, 3, 6]), ("even", 1, [3]), ("stratified", 2, [0, 6]), ("stratified", 1, [0, 6]), ("stratified", 4, [0, 2, 4, 6]), ("endpoints", 9, [0, 6])])
def test_window_starts(spark, strategy, count, expected):
    out = S.sampled_windows(docs(spark, " ".join("abcdefghij")), "k", "x", 4, count, strategy).orderBy("section_id").collect()
    assert [r.start for r in out] == expected and out[0].section_id == "W0001"


def test_short_text_is_one_window(spark):
    out = S.sampled_windows(docs(spark, "a b"), "k", "x", 4, 3).collect()
    assert [(r.start, r.text, r.passage_index) for r in out] == [(0, "a b", "1/1")]


def test_chapters_merge_split_and_skip(spark):
    w = lambda n, c: " ".join([c] * n)
    rows = [(1, 0, "Title page", w(9, "t")), (1, 1, "One", w(2, "a")), (1, 2, "Two", w(2, "b")), (1, 3, "Three", w(2, "c")), (1, 4, "Four", w(11, "d")), (1, 5, "Five", w(1, "e")), (2, 0, "A", "x"), (2, 1, "B", "y")]
    s = spark.createDataFrame(rows, "k int, o int, t string, x string")
    out = S.chapters(s.repartition(3), "k", "o", "t", "x", least=4, most=5).collect()
    got = {(r.section_id, r.title): (r.n_words, r.passage_index) for r in out}
    assert {r.k for r in out} == {1}  # two sections are too few
    assert got[("1", "One / Two")] == (4, "1/5")
    # 'Three' (2 words) is joined to the next one: 13 words in three windows of 4, the last takes the rest
    assert [got[(f"3.{i}", f"Three / Four (part {i}/3)")][0] for i in (1, 2, 3)] == [4, 4, 5]
    assert got[("5", "Five")] == (1, "5/5")


def test_head_mid_tail(spark):
    out = S.head_mid_tail(docs(spark, " ".join("abcdefghij"), "a b"), "k", "x", 3, 2, 3).orderBy("k").collect()
    assert (out[0].opening, out[0].middle, out[0].closing) == ("a b c", "e f", "h i j")
    assert (out[1].opening, out[1].middle, out[1].closing) == ("a b", "", "")


def test_mentions_are_two_windows_apart(spark):
    tokens = spark.createDataFrame([(1, i, f"t{i}") for i in range(60)], "doc int, t int, w string")
    m = spark.createDataFrame([(1, "E", p, 0) for p in (2, 9, 12, 30, 31, 55)] + [(1, "E", 20, 1)], "doc int, e string, start int, rank int")
    out = S.mention_windows(tokens, m, "doc", "t", "w", "e", "start", 5, 3).orderBy("start").collect()
    assert [r.start for r in out] == [9, 30, 55]
    assert out[0].text == " ".join(f"t{i}" for i in range(4, 15))


def test_parts_of_output(spark):
    df = docs(spark, "(A, loves, B)\nno\n(A, meets, C, at sea)", "TIER 1\nx y\nTIER 2\nz\n## SUMMARY\nall")
    t = S.parse_triples(df, "k", "x").orderBy("line").collect()
    assert [(r.s, r.p, r.o, r.ctx) for r in t] == [("A", "loves", "B", None), ("A", "meets", "C", "at sea")]
    parts = S.parse_sections(F.col("x"))
    row = df.filter("k = 1").select(*[c.alias(n.replace(" ", "_")) for n, c in parts.items()]).first()
    assert (row.TIER_1, row.TIER_2, row.SUMMARY) == ("x y", "z", "all")
    lines = spark.createDataFrame([(["a", "b", "c"], ["C02", "C11", "x"])], "l array<string>, i array<string>")
    out = lines.select(S.tail_lines(F.col("l"), 2).alias("t"), S.next_id(F.col("i")).alias("n")).first()
    assert out.t == ["... 1 earlier lines omitted", "b", "c"] and out.n == 12


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.half_century(F.lit(-1))) == "-50--1" and get(X.half_century(F.lit(1749))) == "1700-1749"
    assert get(X.section_seq(F.lit("p500:25"))) == 25 and get(X.section_seq(F.lit("x"))) == 0 and get(X.section_scheme(F.lit("7"))) == "unknown"
    assert get(X.norm_bool(F.lit(""))) is False and get(X.norm_bool(F.lit("maybe"))) is None
    assert get(X.coerce_list(F.lit("['a', 'b']"))) == ["a", "b"] and get(X.coerce_list(F.lit("junk"))) == []
    assert get(X.header_field(F.lit("Title: A\nYear: 1700\nTitle: B\n\nText"), "Title")) == "B"
    assert get(X.id_author(F.lit("x/Smith.Tale.1750"))) == "Smith" and get(X.id_title(F.lit("x/Smith.Tale.1750"))) == "Tale"
    assert X.parse_field_spec("f::e") == {"field": "f", "element": "e", "label": "e"}
    assert X.base_url("ollama", {"LOCAL_BASE_URL": "u"}) == "u" and X.resolve_model("a/b", {}) == "a/b"
    with pytest.raises(KeyError):
        X.resolve_model("nope", {})
