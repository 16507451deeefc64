import json
import random

from pyspark.sql import functions as F

from folioscope import cli
from folioscope.functions import text as X
from folioscope.operators import graph as G
from folioscope.operators import reliability as R
from folioscope.operators import segment as S
from folioscope.operators import stats as T
from folioscope.operators import store
from folioscope.sources import readers, writers


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    nodes = [(g, f"n{i:03d}") for g in "ab" for i in range(80)]
    links = [(rng.choice("ab"), f"n{rng.randrange(90):03d}", f"n{rng.randrange(80):03d}") for _ in range(60)] + [("a", f"n{i + 1:03d}", f"n{i:03d}") for i in range(40, 70)] + [("a", None, "n001")]
    sets = {n: {n} for n in nodes}
    for g, a, b in links:
        if (g, a) in sets and (g, b) in sets:
            whole = sets[(g, a)] | sets[(g, b)]
            sets.update(dict.fromkeys(whole, whole))
    df = spark.createDataFrame(links + links[:5], "graph_id string, a string, b string")
    got = {(r.graph_id, r.id): r.root for r in G.components(df, spark.createDataFrame(nodes, "graph_id string, id string")).collect()}
    assert got == {n: min(s)[1] for n, s in sets.items()}
    assert G.components(df.limit(0), spark.createDataFrame([], "graph_id string, id string")).count() == 0


def network(spark):
    people = spark.createDataFrame([("g", "C1", "The Sailor", "male", 1, "x"), ("g", "C2", "Ann", "female", 2, ""), ("g", "C3", "Annie", "female", 5, "y"), ("g", "C4", "Bo", "", 3, None), ("h", "C1", "Cy", "male", 0, None)], "graph_id string, id string, name string, gender string, seen int, notes string")
    links = spark.createDataFrame([("g", "C3", "C2", "same_as", 1, "P1", ""), ("g", "C1", "C2", "meets", 2, "P2", "inn"), ("g", "C2", "C4", "woos", 3, "P2", "inn"), ("g", "C1", "C9", "woos", 4, None, "")], "graph_id string, a string, b string, type string, ord int, passage string, detail string")
    return people, links


def test_register_and_profiles(spark):
    people, links = network(spark)
    merged = {(r.graph_id, r.root): r for r in G.register(people, links).collect()}
    assert set(merged) == {("g", "C1"), ("g", "C2"), ("g", "C4"), ("h", "C1")}
    assert merged[("g", "C2")].name == "Ann" and merged[("g", "C2")].aliases == ["Annie"] and merged[("g", "C2")].last_seen == 5
    one, two = G.undirected(links, people), G.directed(links, people, only=["woos"])
    wide = {r.graph_id: r for r in G.profiles({"all": (one, False), "woo": (two, True)}, people, ["n_nodes", "n_edges"]).collect()}
    assert (wide["g"].all_n_edges, wide["g"].woo_n_edges, wide["h"].all_n_edges) == (2, 1, 0)
    events = links.filter("type = 'woos'").select("graph_id", F.col("a").alias("who"), F.col("type").alias("what"), F.col("detail").alias("where"))
    s = {r.graph_id: r for r in G.sizes(people, one, events, events, links.filter("passage IS NOT NULL")).collect()}
    assert tuple(s["g"])[1:] == (1, 2, 2, "Ann") and tuple(s["h"])[1:] == (0, 0, 0, "Cy")
    p = {r.graph_id: r for r in G.text_profile(people, events, X.classify_name, {"love": ["woos"]}).collect()}
    assert abs(p["g"].female_share - 2 / 3) < 1e-6 and p["g"].name_type == 0.25 and p["g"].macro_love == 1.0 and p["h"].n_events == 0 and p["h"].macro_love is None


def test_edits_and_columns(spark, tmp_path, capsys):
    path = str(tmp_path / "edits")
    for value in ("first", "last"):
        assert cli.main(["annotate", path, "w::1", "tone", value, "--by", "eve"]) == 0
    rows = store.latest_edits(spark.read.schema(store.HUMAN).parquet(path)).collect()
    assert len(rows) == 1 and json.loads(rows[0].edit) == {"tone": "last"}
    df = spark.createDataFrame([], "_id string, scheme string, seq bigint, tone string, prompt string, meta_x string, _failed boolean")
    assert store.writable(df) == ["tone"]
    facts = spark.createDataFrame([("w", "s", 1, "tone", v, "f", a, "t", 1, "r", None, "") for a, v in (("x", "sad"), ("y", "gay"), ("z", "odd"))], store.FACTS)
    row = cli.side_by_side(facts, ["x", "y"]).first()
    assert (row.x, row.y, row.differs) == ("sad", "gay", True)
    texts = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "_id string, match_group bigint")
    tags = spark.createDataFrame([("a", "novel"), ("c", "tale"), ("a", None)], "_id string, tag string")
    assert {tuple(r) for r in store.of_same_text(texts, tags).collect()} == {("a", "novel"), ("b", "novel"), ("c", "tale")}


def test_prompts(spark):
    df = spark.createDataFrame([("T", None, 1723, "", "ode")], "t string, a string, y int, s string, f string")
    assert df.select(S.meta_prompt(F.col("t"), F.col("a"), F.col("y"), F.col("s"), F.col("f"))).first()[0] == "Title: T\nPrinted: 1700-1749\nForm: ode"
    w = spark.createDataFrame([("run", "verb"), ("run", None), (None, "x")], "w string, p string")
    assert [r[0] for r in w.select(S.word_prompt(F.col("w"), F.col("p"))).collect()] == ["run [verb]", "run", None]
    people = spark.createDataFrame([("t", "1", "Ann"), ("t", "2", "the cook")], "t string, id string, name string")
    seen = spark.createDataFrame([("t", i, f"p{i}", "1") for i in (5, 2, 9, 7)] + [("t", 1, "p", "2")], "t string, seq int, text string, id string")
    assert [r.prompt for r in S.introductions(people, seen, "t", 2).collect()] == ["Who is Ann?\n(2) p2\n(5) p5"]
    k = spark.createDataFrame([(1700, 1700, "Behn, Aphra", "aphra"), (1700, 1701, "Anon.", ""), (1700, 1700, "Anon.", ""), (1700, 1700, "Behn", None), (None, 1700, None, None)], "e int, y int, a string, f string")
    assert [r[0] for r in k.select(X.recognised(F.col("e"), F.col("y"), F.col("a"), F.col("f"))).collect()] == [True, False, True, False, False]


def test_means(spark):
    df = spark.createDataFrame([(1701, "a; b", 1.0), (1709, "b;b", 3.0), (None, None, 5.0)], "y int, tags string, m double")
    assert {tuple(r) for r in T.means_by_decade(df, "y", ["m"]).collect()} == {(1700, 2, 2.0)}
    assert [tuple(r) for r in T.means_by_tag(df, "tags", ["m"]).collect()] == [("b", 2, 2.0), ("a", 1, 1.0)]
    line = spark.createDataFrame([(n, float(n)) for n in range(1, 8)], "size int, m double").withColumn("m", F.log1p("size"))
    assert abs(T.correlations(line, "size", ["m"]).first().r - 1) < 1e-9 and T.correlations(line.limit(5), "size", ["m"]).count() == 0
    members = spark.createDataFrame([(1, "x", 2), (1, "x", 5), (2, "y", 1)], "k int, g string, v int")
    assert {tuple(r) for r in T.group_matrix(members, ["k"], "g", ["x", "y"]).collect()} == {(1, True, False), (2, False, True)}
    assert {tuple(r) for r in T.group_matrix(members, ["k"], "g", ["x", "y"], "v").collect()} == {(1, 5, None), (2, None, 1)}


def test_order_and_presentation(spark):
    df = spark.createDataFrame([(i, "xyx"[i % 3]) for i in range(9)], "k int, v string")
    assert [r.k for r in R.even_order(df, ["k"], 3).collect()] == [r.k for r in R.even_order(df.repartition(3), ["k"], 3).collect()] != list(range(9))
    assert {(r.v, r.rank) for r in R.first_seen_rank(df.withColumn("g", F.lit(1)), ["g"], "v", ["k"]).collect()} == {("x", 1), ("y", 2)}
    models = spark.createDataFrame([(1, "m", "a"), (1, "n", "b"), (2, "m", "c")], "k int, agent string, value string")
    out = R.presentation(spark.createDataFrame([(1,)], "k int"), models, ["k"]).collect()
    assert [(r.k, r.results, r.default_model) for r in out] == [(1, {"m": "a", "n": "b"}, "m")]


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tword\n1\tship\n2\tsail\n")
    assert readers.entity_files(spark, str(tmp_path / "t.tsv")).dtypes == [("id", "string"), ("word", "string")]
    assert readers.entity_files(spark, str(tmp_path / "t.tsv"), "id int, word string").agg(F.sum("id")).first()[0] == 3
    book = {"characters": [{"id": 4, "count": 9, "mentions": {"proper": [{"n": "Ann", "c": 2}, {"n": "Miss Ann", "c": 3}], "common": [], "pronoun": [{"n": "she", "c": 4}]}}, {"id": 5, "count": 1, "mentions": {"proper": [], "common": [], "pronoun": [{"n": "he", "c": 1}]}}]}
    (tmp_path / "c.json").write_text(json.dumps(book))
    assert {(r.id, r.name, r.rank) for r in readers.cluster_files(spark, str(tmp_path / "c.json")).collect()} == {(4, "Miss Ann", 0), (5, "he", 2)}
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert readers.pdf_files(spark, str(tmp_path)).first().length == 4
    rows = spark.createDataFrame([("My Book.txt", "org/Model-1.5", 1)], "source string, model string, n int")
    writers.results_json(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert json.loads(back.first().value)["n"] == 1 and back.first()["name"].endswith(".json")
    md = writers.markdown(spark.createDataFrame([("T", "body", "sad")], "title string, text string, tone string"), "title", "text", ["tone"]).first().markdown
    assert md.startswith("## T") and "**tone**: sad" in md and md.endswith("body")
    assert [r.n_words for r in readers.passages_from_list(spark, ["a b", ""]).orderBy("seq").collect()] == [2, 0]


def test_tables(spark):
    store.create(spark, "annotations_test")
    store.create(spark, "annotations_test")  # a second time changes nothing
    assert spark.table("annotations_test.facts").count() == 0 and spark.table("latest_annotations").count() == 0
    spark.sql("DROP DATABASE annotations_test CASCADE")
