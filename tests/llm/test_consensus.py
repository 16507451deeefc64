import random

import pytest

from folioscope.llm.consensus import Scale, consensus

SCHEMA = "item int, field string, annotator string, value array<string>, question string"


def run(spark, rows, scales, **kw):
    return consensus(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), scales, **kw)


def test_skill_beats_majority(spark):
    """Three annotators who are nearly always right outvote four who guess, and one who is always wrong helps."""
    rng = random.Random(1)
    truth = {i: rng.choice(["x", "y"]) for i in range(400)}
    flip = {"x": "y", "y": "x"}
    rows = []
    for i, t in truth.items():
        rows += [(i, "f", f"good{k}", [t if rng.random() < 0.93 else flip[t]]) for k in range(3)]
        rows += [(i, "f", f"coin{k}", [rng.choice(["x", "y"])]) for k in range(4)]
        rows.append((i, "f", "wrong", [flip[t] if rng.random() < 0.9 else t]))
    labels, reliability, agreement, dependence = run(spark, rows, [Scale("f", ("x", "y"))])
    right = sum(truth[r.item] == r.value for r in labels.collect()) / 400
    plain = sum(truth[i] == max("xy", key=lambda v: sum(r[3] == [v] for r in rows if r[0] == i)) for i in truth) / 400
    assert right > 0.96 and right > plain + 0.03
    acc = {r.annotator: r.accuracy for r in reliability.collect()}
    assert acc["good0"] > 0.88 and acc["wrong"] < 0.2 and 0.4 < acc["coin0"] < 0.6
    assert agreement.first().alpha < 0.6
    assert {r.annotator: r.witness for r in dependence.collect()} == {a: a for a in acc}


def test_copies_add_no_weight(spark):
    rng = random.Random(2)
    truth = {i: rng.choice(["x", "y"]) for i in range(800)}
    flip = {"x": "y", "y": "x"}
    rows = []
    for i, t in truth.items():
        bad = t if rng.random() < 0.75 else flip[t]
        rows += [(i, "f", f"copy{k}", [bad if rng.random() < 0.97 else flip[bad]]) for k in range(2)]
        rows += [(i, "f", f"good{k}", [t if rng.random() < 0.85 else flip[t]]) for k in range(5)]
    labels, _, _, dependence = run(spark, rows, [Scale("f", ("x", "y"))])
    right = sum(truth[r.item] == r.value for r in labels.collect()) / 800
    groups = {r.annotator: r.witness for r in dependence.collect()}
    assert groups["copy0"] == groups["copy1"] and len(set(groups.values())) == 6 and right > 0.92


def test_sets_and_defined_cases(spark):
    rows = [(1, "s", a, v) for a, v in (("a", ["p", "q"]), ("b", ["p"]), ("c", ["p", "p"]))]
    rows += [(2, "s", a, v) for a, v in (("a", []), ("b", []), ("c", ["q"]))]
    rows += [(3, "s", "a", ["p"]), (3, "s", "b", None), (3, "s", "c", ["other"]), (3, "s", "c", ["p"])]  # two votes only
    rows += [(4, "unknown", "a", ["p"]), (4, "s", None, ["p"]), (5, "one", "a", ["p", "q"])]
    rows += rows
    labels, *_ = run(spark, rows, [Scale("s", ("p", "q"), True), Scale("one", ("p", "q"))])
    got = {(r.item, r.question): (r.value, r.annotators) for r in labels.collect()}
    assert got == {(1, "s:p"): ("true", 3), (1, "s:q"): ("false", 3), (2, "s:p"): ("false", 3), (2, "s:q"): ("false", 3)}


def test_empty(spark):
    out = run(spark, [], [Scale("f", ("x", "y"))])
    assert [d.count() for d in out] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        run(spark, [], [])


def test_many_labels(spark):
    """More labels than one number has bits."""
    names = tuple(f"l{i}" for i in range(70))
    rows = [(i, "s", a, [f"l{i}", "l69"]) for i in range(5) for a in "abc"]
    labels, *_ = run(spark, rows, [Scale("s", names, True)], rounds=3)
    assert {(r.item, r.question) for r in labels.collect() if r.value == "true"} == {(i, q) for i in range(5) for q in (f"s:l{i}", "s:l69")}


def test_four_copies_add_no_weight(spark):
    """Four copies of one weak annotator, more than a joint matrix holds, against three good ones."""
    rng = random.Random(7)
    truth = {i: rng.choice(["x", "y"]) for i in range(900)}
    flip = {"x": "y", "y": "x"}
    rows = []
    for i, t in truth.items():
        bad = t if rng.random() < 0.75 else flip[t]
        rows += [(i, "f", f"copy{k}", [bad if rng.random() < 0.98 else flip[bad]]) for k in range(4)]
        rows += [(i, "f", f"good{k}", [t if rng.random() < 0.9 else flip[t]]) for k in range(6)]
    labels, _, _, dependence = run(spark, rows, [Scale("f", ("x", "y"))])
    groups = {r.annotator: r.witness for r in dependence.collect()}
    assert len({groups[f"copy{k}"] for k in range(4)}) == 1 and len(set(groups.values())) == 7
    assert sum(truth[r.item] == r.value for r in labels.collect()) / 900 > 0.95
