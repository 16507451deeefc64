import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.plans import extract as E
from folioscope.plans.task import Field, TaskSpec, parse_json, prefix_of, resolve_task, unwrap, validate

ONE = TaskSpec("meter", (Field("feet", "int"), Field("verse")), retries=1)
MANY = TaskSpec("ships", (Field("ship"), Field("rig", "enum", ("sloop", "brig"))), is_list=True, retries=0)


@pytest.mark.parametrize("text", ['{"feet": 5, "verse": "iamb"}', '```json\n{"feet": 5, "verse": "iamb"}\n```', 'I count {"feet": 5, "verse": "iamb"}, I think.', "{'feet': 5, 'verse': 'iamb',}", '{feet: 5, verse: "iamb"', '{"feet": 5, "verse": "iamb"'])
def test_parse_json(text):
    assert parse_json(text) == {"feet": 5, "verse": "iamb"}


def test_parse_fails_on_garbage():
    with pytest.raises(ValueError):
        parse_json("nothing here")


def test_unwrap_and_validate():
    assert unwrap({"properties": {"feet": 4, "verse": "ode"}}, ["feet", "verse"]) == {"feet": 4, "verse": "ode"}
    assert unwrap({"verse": {"type": "string", "value": "ode"}}, ["verse"]) == {"verse": "ode"}
    assert validate({"ship": "Argo", "rig": "brig"}, MANY) == [{"ship": "Argo", "rig": "brig"}]
    with pytest.raises(ValueError, match="rig"):
        validate([{"ship": "Argo", "rig": "raft"}], MANY)
    with pytest.raises(ValueError, match="missing"):
        validate({"feet": 4}, ONE)
    assert prefix_of("passage-content-x") == "content_x."
    with pytest.raises(KeyError):
        resolve_task("no-such-task")


class Counting:
    """A provider that notes each call in a file, so that calls on workers can be counted."""

    name = "counting"

    def __init__(self, path, bad_first=False, always_bad=False):
        self.path, self.bad_first, self.always_bad = path, bad_first, always_bad

    def call(self, prompt, system, model, temperature, max_tokens, image=None):
        with open(self.path, "a") as f:
            f.write("x")
        if self.always_bad or (self.bad_first and not prompt.startswith("The last answer")):
            return "bad"
        return json.dumps({"feet": 1, "verse": prompt[-1:]})


def calls(path):
    return len(path.read_text()) if path.exists() else 0


def test_cache_retry_and_failure(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "i int, prompt string")
    out = E.extract(df, ONE, Counting(str(log)), cache=cache).orderBy("i").collect()
    assert [r.result.verse for r in out] == ["a", "b", "a"] and calls(log) == 2  # equal prompts are asked once
    more = df.unionByName(spark.createDataFrame([(3, "c")], "i int, prompt string"))
    assert E.extract(more, ONE, Counting(str(log)), cache=cache).count() == 4 and calls(log) == 3
    assert E.extract(df, ONE, Counting(str(log)), cache=cache, force=True).count() == 3 and calls(log) == 5
    again = tmp_path / "again"
    out = E.extract(df, ONE, Counting(str(again), bad_first=True)).collect()
    assert calls(again) == 4 and {r.attempts for r in out} == {2}
    never = tmp_path / "never"
    out = E.extract(df, ONE, Counting(str(never), always_bad=True)).collect()
    assert calls(never) == 4 and all(r._failed and r.result is None and r._error for r in out)


def test_metadata_is_part_of_the_key(spark):
    df = spark.createDataFrame([("p", "m1"), ("p", "m2")], "prompt string, m string")
    keys = df.select(E.cache_key(F.col("prompt"), F.lit("x"), ONE, F.struct("m"))).distinct().count()
    assert keys == 2


def test_list_results_explode(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y")], "i int, prompt string")
    rule = E.RuleProvider(lambda p: [] if p.endswith("y") else [{"ship": "Argo", "rig": "brig"}, {"ship": "Swan", "rig": "sloop"}])
    out = E.results(E.extract(df, MANY, rule), MANY, ["i"])
    assert {(r.i, r.ship, r.rig) for r in out.collect()} == {(0, "Argo", "brig"), (0, "Swan", "sloop")}


def test_cast_joins_sets():
    c = E.Cast()
    for n in (4, 2, 6, 9):
        c.enter({"id": f"C{n}", "name": f"n{n}"})
    c.enter({"id": "4", "name": "no number"})
    c.join("C6", "C9")
    c.join("C04", "C9")
    c.join("C4", "C4")
    c.join("C40", "C2")  # never entered: the known one stands for it
    c.join("C50", "C51")
    assert [(p["id"], p["name"], p["aliases"]) for p in c.people()] == [("C02", "n2", []), ("C04", "n4", ["n6", "n9"])]
    assert [c.name(x) for x in ("C9", "C06", "C40", "C50", "Ishmael")] == ["C04", "C04", "C02", "C50", "Ishmael"]
    assert c.free == 41 and c.listed().endswith("numbered from C41 on.")
    c.enter({"id": "C4", "name": "anew"})
    assert c.people()[1]["aliases"] == [] and c.name("C9") == "C04"


def test_cast_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        c, sets = E.Cast(), {n: {n} for n in range(1, 12)}
        for n in sets:
            c.enter({"id": f"C{n}", "name": str(n)})
        for _ in range(8):
            a, b = rng.randrange(1, 12), rng.randrange(1, 12)
            c.join(f"C{a}", f"C{b}")
            whole = sets[a] | sets[b]
            sets.update(dict.fromkeys(whole, whole))
        assert all(c.name(f"C{n}") == E.Cast.write(min(s)) for n, s in sets.items())
        assert {p["id"]: sorted(map(int, [p["name"], *p["aliases"]])) for p in c.people()} == {E.Cast.write(min(s)): sorted(s) for s in sets.values()}


class Scribe:
    """Answers for the chunks of a story by their only word; counts its calls in a file."""

    name = "scribe"

    def __init__(self, path):
        self.path = path

    def call(self, prompt, system, model, temperature, max_tokens, image=None):
        with open(self.path, "a") as f:
            f.write("x")
        word = prompt.rpartition("\n")[2]
        if word == "blot":
            return "illegible"
        n = {"fox": 1, "owl": 2, "hen": 3}.get(word, 4)
        same = [{"a": "C2", "b": "C1", "type": "same_as"}] if word == "owl" else []
        return json.dumps({"new_characters": [{"id": f"C{n}", "name": word}], "relations": [*same, {"a": "C2", "b": "C3", "type": "fears"}, {"a": "C2", "type": "half"}], "chunk_summary": word})


def story(spark):
    rows = [("t", i, x, 1) for i, x in enumerate(["fox", "owl", "blot", "hen"])] + [("u", 0, "elk", 1)]
    return spark.createDataFrame(rows, "t string, o int, x string, n int").repartition(4)


def test_fold_is_ordered_and_survives_failures(spark, tmp_path):
    out = E.fold(story(spark), "t", "o", "x", "n", E.StoryFold(), Scribe(str(tmp_path / "log")), chunk=1)
    rows = {r.t: r for r in out.collect()}
    doc = json.loads(rows["t"].result)
    assert (rows["t"].n_chunks, rows["t"].n_failed, rows["u"].n_passages) == (4, 1, 1)
    assert [(c["id"], c["name"], c["aliases"]) for c in doc["characters"]] == [("C01", "fox", ["owl"]), ("C03", "hen", [])]
    assert [r["a"] for r in doc["relations"] if r["type"] == "fears"] == ["C02", "C01", "C01"]
    assert [s["text"] for s in doc["summaries"]] == ["fox", "owl", "hen"]
    assert tuple(E.fold_report(out).first()) == (2, 1, 1, 5, 1)


def test_fold_goes_on_where_it_stopped(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "answers")
    once = E.fold(story(spark), "t", "o", "x", "n", E.StoryFold(), Scribe(str(log)), chunk=1, cache=cache, calls=1)
    assert calls(log) == 5 and {r.t: r.n_cached for r in once.collect()} == {"t": 3, "u": 0}
    again = E.fold(story(spark), "t", "o", "x", "n", E.StoryFold(), Scribe(str(log)), chunk=1, cache=cache)
    assert calls(log) == 5 and {r.t: r.result for r in again.collect()} == {r.t: r.result for r in once.collect()}
    E.fold(story(spark), "t", "o", "x", "n", E.StoryFold(), Scribe(str(log)), chunk=2, cache=cache)
    assert calls(log) == 8  # another chunk size is another key


def test_command_line(capsys):
    from folioscope import cli

    assert cli.main(["ls"]) == 0 and "text-shape" in capsys.readouterr().out
    assert cli.main(["show", "text-shape"]) == 0 and "n_words: int" in capsys.readouterr().out
    assert cli.main(["run", "no-such-query", "/tmp"]) == 2


