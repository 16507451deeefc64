import json
import random

from folioscope.operators import reliability as R

SCHEMA = "k int, field string, agent string, value string"


def votes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, kind, values, ref=None, order=("r", "a", "b", "c", "d"), counted=None):
    v = votes(spark, [(1, "f", a, x) for a, x in values.items()])
    c = None if counted is None else v.filter(v.agent.isin(counted))
    row = R.consensus(v, ["k"], {"f": kind}, list(order), ref, c).first()
    return row.value, row.tier


def test_bool_ties(spark):
    assert one(spark, "bool", {"a": "true", "b": "false"}) == ("true", "majority")
    assert one(spark, "bool", {"a": "true", "b": "false", "r": None}, "r") == ("true", "majority")
    assert one(spark, "bool", {"a": "true", "b": "false", "c": "false", "r": "true"}, "r") == ("true", "majority")
    assert one(spark, "bool", {"a": None}) == (None, "no_vote")


def test_reference_breaks_ties_though_excluded(spark):
    assert one(spark, "bool", {"r": "false", "a": "true", "b": "false"}, "r", counted=["a", "b"])[0] == "false"
    assert one(spark, "enum", {"r": "z", "a": "y", "b": "z"}, "r", counted=["a", "b"])[0] == "z"


def test_enum_plurality(spark):
    assert one(spark, "enum", {"a": "x", "b": "y", "c": "y", "d": ""}) == ("y", "majority")
    assert one(spark, "enum", {"a": "y", "b": "x"}) == ("x", "majority")
    assert one(spark, "enum", {"a": "", "b": None}) == (None, "single_vote")


def test_list_majority(spark):
    j = json.dumps
    assert one(spark, "list", {"a": j(["p"]), "b": j(["p", "q"]), "c": "[]"}) == ('["p"]', "majority")
    assert one(spark, "list", {"a": j(["p"]), "r": j(["q"])}, "r")[0] == '["q"]'
    assert one(spark, "list", {"a": None}) == ("[]", "no_vote")
    assert one(spark, "list", {"a": j(["p"]), "b": j(["q"]), "c": j(["s"])}) == ("[]", "no_consensus")


def test_trust_is_null_safe(spark):
    v = votes(spark, [(1, "f", "r", None), (1, "f", "a", None), (2, "f", "r", "x"), (2, "f", "a", "y"), (3, "f", "b", "x")])
    assert {r.agent: (r.trust, r.n) for r in R.trust(v, ["k"], "r").collect()} == {"a": (0.5, 2), "b": (None, 0)}
    assert R.allowed(v, "r", R.trust(v, ["k"], "r"), 0.4).select("agent").distinct().count() == 2


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, "f", a, rng.choice(["x", "y", None])) for k in range(30) for a in "abc" if rng.random() < 0.8]
    at = {(k, a): x for k, _, a, x in rows}
    for r in R.pairwise(votes(spark, rows), ["k"]).collect():
        both = [(at[(k, r.agent_a)], at[(k, r.agent_b)]) for k in range(30) if (k, r.agent_a) in at and (k, r.agent_b) in at]
        assert r.n == len(both) and abs(r.agreement - sum(x == y for x, y in both) / len(both)) < 1e-9


def test_audit_skips_nulls(spark):
    v = votes(spark, [(1, "f", "r", None), (1, "f", "a", "x"), (2, "f", "r", "y"), (2, "f", "a", "x"), (2, "f", "b", "x")])
    c = R.consensus(v, ["k"], {"f": "enum"}, ["r", "a"], "r")
    assert {r.k: r.flagged for r in R.audit(c, v, ["k"], "r").collect()} == {1: False, 2: True}


def test_lists_disagree_as_sets(spark):
    v = votes(spark, [(1, "f", "a", '["x", "y"]'), (1, "f", "b", '["y", "x"]'), (1, "f", "c", None), (2, "f", "a", "u"), (2, "f", "b", "w")])
    assert {r.k: r.disagree for r in R.disagreements(v, ["k"]).collect()} == {1: False, 2: True}
