"""Attribute-value rows into wide tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.functions import values as V
from folioscope.operators import wide as W

ATTRS = [W.Attribute("n", "int"), W.Attribute("share", "float"), W.Attribute("tense", "enum", ("past", "present")), W.Attribute("ok", "bool"), W.Attribute("tags", "list", ("a_b", "c")), W.Attribute("note", "str")]
SCHEMA = "id string, field string, value string, at timestamp, extra string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def widen(spark, rows):
    return {r["id"]: r.asDict() for r in W.widen(spark.createDataFrame(rows, SCHEMA), ["id"], "field", "value", "at", ATTRS).collect()}


@pytest.mark.parametrize(("text", "value"), [("1,004", 1004), ("+7", 7), (" 12.0", 12), ("00298", 298), ("12.5", None), ("12-ish", None), ("3 or 4", None), ("", None), (None, None), ("inf", None), ("1e3", 1000)])
def test_int(spark, text, value):
    assert spark.createDataFrame([(text,)], "v string").select(V.as_int(F.col("v"))).first()[0] == value


@pytest.mark.parametrize(("text", "value"), [("0,25", 0.25), (".5", 0.5), ("40%", 0.4), ("5.10e-01", 0.51), ("1 ", 1.0), ("NaN", None), ("inf", None), ("--", None), ("high", None), ("1,234.5", 1234.5)])
def test_float(spark, text, value):
    assert spark.createDataFrame([(text,)], "v string").select(V.as_float(F.col("v"))).first()[0] == value


@pytest.mark.parametrize(("text", "value"), [('["a_b", "c"]', ["a_b", "c"]), ("['C']", ["c"]), ("a b; c", ["a_b", "c"]), ("[]", []), ('["a_b", "c', None), ("['a_b', 'c", None), ('{"tags": }', None), ("see note", None), ("", None), ('["c", "c"]', ["c"]), ("c", ["c"])])
def test_list(spark, text, value):
    assert spark.createDataFrame([(text,)], "v string").select(V.as_label_list(F.col("v"), V.label_keys(["a_b", "c"]))).first()[0] == value


def test_latest_write_decides_even_if_unreadable(spark):
    out = widen(spark, [("x", "n", "1", at(1), ""), ("x", "N ", "several", at(2), ""), ("y", "n", "1", at(2), ""), ("y", "n", None, at(9), ""), ("y", "n", "5", at(1), "")])
    assert out["x"]["n"] is None and out["y"]["n"] == 1


def test_columns_are_typed_and_aligned(spark):
    rows = [("x", "share", "50%", at(1), ""), ("x", "Tense", " PAST", at(1), ""), ("y", "ok", "Yes", at(1), ""), ("y", "tags", '["c"]', at(1), ""), ("y", "note", " a  b ", at(1), ""), ("y", "note", " a  b ", at(1), "")]
    out = widen(spark, rows)
    assert out["x"] == {"id": "x", "n": None, "share": 0.5, "tense": "past", "ok": None, "tags": None, "note": None}
    assert out["y"] == {"id": "y", "n": None, "share": None, "tense": None, "ok": True, "tags": ["c"], "note": "a b"}


def test_entities_keep_their_row(spark):
    out = widen(spark, [("x", "n", None, at(1), ""), ("z", "unknown_field", "1", at(1), ""), (None, "n", "3", at(1), "")])
    assert set(out) == {"x", "z", None} and out[None]["n"] == 3 and out["x"]["n"] is None


def test_ties_empty_and_clashes(spark):
    assert widen(spark, [("x", "n", "1", at(1), ""), ("x", "n", "2", at(1), "")])["x"]["n"] == 2
    assert widen(spark, []) == {}
    with pytest.raises(ValueError, match="keys that are also attributes"):
        W.widen(spark.createDataFrame([], "n string, field string, value string, at timestamp"), ["n"], "field", "value", "at", ATTRS)


def test_brute_force_over_batches(spark):
    """Many entities in small Arrow batches give what a dictionary gives."""
    import random

    rng = random.Random(5)
    rows = [(f"e{rng.randrange(300)}", rng.choice(["n", "note", "OK", "other"]), rng.choice(["1", "2", "yes", "no", "x", None]), at(rng.randrange(50)), "") for _ in range(4000)]
    best = {}
    for i, f, v, t, _ in rows:
        if v is not None:
            best[(i, f.lower())] = max(best.get((i, f.lower()), (t, v)), (t, v))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = widen(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(out) == {r[0] for r in rows}
    for i, row in out.items():
        n = best.get((i, "n"), (0, ""))[1]
        ok = best.get((i, "ok"), (0, ""))[1]
        assert row["n"] == (int(n) if n.isdigit() else None)
        assert row["ok"] == {"yes": True, "1": True, "no": False}.get(ok)
        assert row["note"] == best.get((i, "note"), (0, None))[1]


def test_cells_round_trip(spark):
    table = W.widen(spark.createDataFrame([("x", "share", "1", at(1), ""), ("x", "tags", "[]", at(1), ""), ("x", "ok", "0", at(1), "")], SCHEMA), ["id"], "field", "value", "at", ATTRS)
    assert {(r.field, r.value) for r in W.cells(table, ["id"], ATTRS).collect()} == {("share", "1.0000"), ("tags", ""), ("ok", "false")}


def test_ordinals_are_global(spark):
    rows = [(f"e{i % 40}", "n", str(i), at(1), "") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = [(r.o, r.id) for r in W.widen(df, ["id"], "field", "value", "at", ATTRS, ordinal="o").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({o for o, _ in out}) == len(out) == 40
    ranges = {}
    for o, i in sorted(out):
        ranges.setdefault(o // W.RANGE, []).append((o % W.RANGE, i))
    # within the range of a partition the ordinals are dense and follow the entities
    assert all([o for o, _ in r] == list(range(len(r))) and [i for _, i in r] == sorted(i for _, i in r) for r in ranges.values())


def test_many_attributes(spark):
    many = [W.Attribute(f"a{i}", ("enum", "int", "list")[i % 3], ("x", "y")) for i in range(600)]
    rows = [("e", f"a{i}", ("X", "7", "[x]")[i % 3], at(1), "") for i in range(600)]
    out = W.widen(spark.createDataFrame(rows, SCHEMA), ["id"], "field", "value", "at", many).first()
    assert all(out[f"a{i}"] == ("x", 7, ["x"])[i % 3] for i in range(600))
