import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import store as A
from folioscope.sources import readers as R
from folioscope.sources import writers as W
from folioscope.streaming import annotations as S


def at(n):
    return dt.datetime(2025, 1, 1, 0, 0, n)


def facts(spark, rows):
    full = [("t", "p", s, f, v, "llm", a, "task", ver, run, at(n), "{}") for s, f, v, a, ver, run, n in rows]
    return spark.createDataFrame(full, A.FACTS)


def test_latest_and_ties(spark):
    f = facts(spark, [(0, "x", "old", "a", 1, "r", 1), (0, "x", "new", "a", 1, "r", 2), (0, "x", "b", "a", 1, "r2", 2), (0, "x", "other", "a", 2, "r", 0)])
    out = {(r.task_version): (r.value, r.source) for r in A.latest(f.repartition(3)).collect()}
    assert out == {1: ("b", "llm:a:task:v1"), 2: ("other", "llm:a:task:v2")}
    assert A.newest_version(f).select("task_version").distinct().collect()[0][0] == 2


def test_scan_filters_are_optional_and_pushed(spark, tmp_path):
    f = facts(spark, [(0, "x", "1", "a", 1, "r", 1), (1, "y", "2", "b", 2, "r", 1)])
    A.append(f, str(tmp_path / "s"))
    A.append(f, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert A.scan(stored).count() == 4 and A.scan(stored, fields=["x"], agent="a", version=1).count() == 2
    plan = A.scan(stored, ids=["t"], agent="a", task="task")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source_agent)" in plan.replace("\n", "") or "EqualTo(source_agent,a)" in plan
    assert "PartitionFilters: [isnotnull(task" in plan


def test_write_skips_nulls_keeps_empty_lists(spark):
    wide = spark.createDataFrame([("t", "p", 0, True, [], None), ("t", "p", 1, None, ["a"], "s")], "_id string, scheme string, seq int, b boolean, l array<string>, s string")
    out = A.to_facts(wide, {"b": "bool", "l": "list", "s": "str"}, "llm", "a", "t", 1, "r", F.timestamp_seconds(F.lit(0))).collect()
    assert {(r.seq, r.field, r.value) for r in out} == {(0, "b", "true"), (0, "l", "[]"), (1, "l", '["a"]'), (1, "s", "s")}
    back = A.pivot(A.latest(spark.createDataFrame(out, A.FACTS)), ["_id", "seq"], ["b", "l", "s"], ["b"]).orderBy("seq").collect()
    assert back[0].b is True and back[1].s == "s" and back[1].b is None


def test_keep_last_and_configs(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("m", 0, None)], "k string, o int, v string")
    assert {r.k: r.v for r in A.keep_last(df.repartition(4), ["k"], ["o"]).collect()} == {"k": "c", "m": None}
    a = A.config_sha256("t", "m", "s", {"a": 1, "b": 2}, [], 0.2, 10, 1)
    assert a == A.config_sha256("t", "m", "s", {"b": 2, "a": 1}, [], 0.2, 10, 1) and a != A.config_sha256("t", "m", "s", {}, [], 0.2, 10, 1)
    c = spark.createDataFrame([("h", "x", at(2)), ("h", "y", at(1))], "config_sha256 string, task string, first_seen timestamp")
    assert A.configs(c).first().task == "y"


def test_shards_are_a_partition(spark):
    df = spark.range(100)
    parts = [set(r.id for r in A.shard(df, ["id"], i, 3).collect()) for i in range(3)]
    assert sum(map(len, parts)) == 100 and len(set.union(*parts)) == 100


def test_passage_files(spark, tmp_path):
    (tmp_path / "quarto_Q1.jsonl").write_text('{"_id": "_real/Q1", "_n_passages": 2}\n\n{"seq": 0, "text": "a b"}\n{"seq": 1, "text": "c", "n_words": 9}\n')
    (tmp_path / "fenrow_T2.jsonl").write_text('{"seq": 5, "text": "z"}\n')
    out = {(r._id, r.seq): r.n_words for r in R.passages_from_jsonl(spark, str(tmp_path / "*.jsonl")).collect()}
    assert out == {("_real/Q1", 0): 2, ("_real/Q1", 1): 9, ("_fenrow/T2", 5): 1}
    (tmp_path / "book.txt").write_text("one two three")
    assert [r.text for r in R.passages_from_text(spark, str(tmp_path / "book.txt"), 2).orderBy("seq").collect()] == ["one two", "three"]
    assert R.passages_from_list(spark, ["a b", ""]).orderBy("seq").collect()[1].n_words == 0


def test_manifest_and_names(spark, tmp_path):
    (tmp_path / "m.csv").write_text("_id,seq,tag\nx,1,a\nx,9,b\n")
    have = spark.createDataFrame([("x", 1, "text")], "_id string, seq bigint, text string")
    found, missing = R.attach(R.manifest(spark, str(tmp_path / "m.csv")), have)
    assert found.first().text == "text" and missing.first().tag == "b" and R.manifest_keys(spark, str(tmp_path / "m.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("id,seq\nx,1\n")
    with pytest.raises(ValueError, match="_id"):
        R.manifest(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "names.txt").write_text("head,x,A,B,c\n1,x,Ann,Bo,c\n2,y,ANN\n3,x,Cy,,e\n")
    assert {r.name for r in R.name_list(spark, str(tmp_path / "names.txt")).collect()} == {"ann", "bo", "cy"}
    (tmp_path / "i.JPG").write_bytes(b"x")
    assert R.images(spark, str(tmp_path / "i.JPG")).first().mime == "image/jpeg"


def test_migration_is_idempotent(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text('{"_id": "x", "section_id": "1", "annotator": "a", "good": true}\n{"_id": "y", "section_id": "1", "annotator": "a", "good": false}\n')
    new = str(tmp_path / "new")
    assert W.migrate_annotations(spark, str(tmp_path / "old.jsonl"), new) == 2
    assert W.migrate_annotations(spark, str(tmp_path / "old.jsonl"), new) == 0


def test_results_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], True, "long")], "i int, l array<string>, _failed boolean, text string")
    W.results_csv(df, str(tmp_path / "o"))
    back = spark.read.csv(str(tmp_path / "o"), header=True, escape='"')
    assert back.columns == ["i", "l", "_failed"] and back.first().l == '["a"]'


def test_stream_with_state(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, ids in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([("g", x) for x in ids], "graph_id string, id string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("graph_id string, id string").option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    q = S.running_register(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(r.n_characters for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[-1] == 3 and seen[0] == 2


def test_round_trip_of_many_texts_takes_few_files(spark, monkeypatch):
    """Files are counted where they are read; every passage of every text comes back, and each text has its header before its passages, in one file."""
    from folioscope.queries import inputs

    docs = spark.createDataFrame([(i, " ".join(f"w{i}.{j}" for j in range(61 + i % 120)) if i % 50 else None) for i in range(600)], "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(inputs, "_space", lambda s, name, made=inputs._space: seen.append(made(s, name)) or seen[-1])
    got = inputs._jsonl(spark, docs)
    want = {(f"_docs/D{i}", k, len(ws)) for i in range(600) if i % 50 for k, ws in enumerate([range(61 + i % 120)[a : a + 60] for a in range(0, 61 + i % 120, 60)])}
    assert {(r._id, r.seq, r.n_words) for r in got.collect()} == want and got.count() == len(want)
    lines = spark.read.option("recursiveFileLookup", True).text(seen[0]).selectExpr("_metadata.file_name AS f", "value")
    files = lines.groupBy("f").agg(F.collect_list("value").alias("v")).collect()
    assert len(files) < 60
    left = {}
    for line in (json.loads(x) for r in files for x in r.v):
        if "seq" not in line:
            assert not any(left.values())
            left = {line["_id"]: line["_n_passages"]}
        else:
            left[line["_id"]] -= 1


def test_folders_of_single_texts_come_back(spark, tmp_path):
    p = spark.createDataFrame([("_a/X1", 0, "one two", 2), ("_a/X1", 1, "three", 1), ("_b/Y", 0, "four", 1)], "_id string, seq bigint, text string, n_words int")
    W.passages_jsonl(p, str(tmp_path / "out"))
    got = R.passages_from_jsonl(spark, str(tmp_path / "out/*/*.txt")).select(*p.columns)
    assert sorted(got.collect()) == sorted(p.collect()) and len(list((tmp_path / "out").glob("slug=*"))) == 2
