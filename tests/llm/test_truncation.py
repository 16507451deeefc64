import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm.truncation import cut_off

SUBJECTS = ["The old sailor", "My aunt", "Her cousin", "That clerk"]
VERBS = ["sold", "praised", "burned", "found"]
OBJECTS = ["the silver kettle", "a broken lantern", "his little garden", "this heavy ledger"]
ENDS = ["before the harvest", "in the second winter", "by candlelight", "without any warning"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(900):
        if i % 10 == 9:  # verse: lines without a full stop
            text = "\n".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}" for _ in range(6))
        else:
            text = " ".join(sentence(rng) for _ in range(rng.randrange(3, 9)))
        if i % 7 == 0:
            at = rng.randrange(len(text) // 2, len(text) - 12)
            inside = text[:at].rstrip()
            if not inside.endswith(".") and text[len(inside) : len(inside) + 1] != "\n":
                text = inside + rng.choice(["", "", "�", "-"] if text[at - 1].isalpha() and text[at].isalpha() else [""])
                cut.add(i)
        rows.append((i, text, "s" + str(i % 3), True))
    return rows, cut


def test_finds_cut_texts(spark, corpus):
    rows, cut = corpus
    judged = cut_off(spark.createDataFrame(rows, "doc_id int, text string, source string, cut boolean")).collect()
    assert {(r.doc_id, r.source) for r in judged} == {(r[0], r[2]) for r in rows}
    out = {r.doc_id: r.cut for r in judged}
    found = {i for i, c in out.items() if c}
    assert len(found & cut) / len(cut) > 0.9 and len(found - cut) <= 0.03 * len(found)


def test_added_ellipsis_at_a_field_limit(spark, corpus):
    rng = random.Random(9)
    rows = list(corpus[0])
    for i in range(40):
        text = " ".join(sentence(rng) for _ in range(9))
        rows.append((2000 + i, text[:297] + "...", "limited", True))
        rows.append((3000 + i, f"{sentence(rng)} At length, my aunt found {rng.choice(OBJECTS)}…", "writer", True))
        rows.append((4000 + i, f"{sentence(rng)}\n\nLaus Deo", "printer", True))
        rows.append((4500 + i, f"{sentence(rng)} &quo", "feed", True))
    out = {r.doc_id: r.cut for r in cut_off(spark.createDataFrame(rows, "doc_id int, text string, source string, cut boolean")).collect()}
    assert sum(out[2000 + i] for i in range(40)) >= 36 and sum(out[3000 + i] for i in range(40)) == 0
    assert not any(out[4000 + i] for i in range(40)) and all(out[4500 + i] for i in range(40))


def test_defined_cases(spark, corpus):
    odd = [(5000, None, "s0", True), (5001, "", "s0", True), (5002, " \n ", "s0", True), (5003, "***", None, True), (5004, "Word", None, True), (5005, " ".join(["The old sailor sold the silver kettle by candlelight."] * 4000), None, True), (5007, "The old sailor sold the" + " " * 200, "s1", True), (5008, "The old sailor sold the silver kettle by candlelight." + " " * 60, "s1", True), (5006, "The old sailor sold the", "s1", True), (5006, "The old sailor sold the", "s1", True)]
    out = cut_off(spark.createDataFrame(list(corpus[0]) + odd, "doc_id int, text string, source string, cut boolean"))
    got = {r.doc_id: r.cut for r in out.collect()}
    assert not {5000, 5001, 5002, 5003} & set(got) and got[5005] is got[5008] is False and got[5006] is got[5007] is True
    assert out.filter("doc_id = 5006").count() == 2
    assert cut_off(spark.createDataFrame([], "doc_id int, text string, source string")).count() == 0


def test_only_sql(spark, corpus):
    plan = cut_off(spark.createDataFrame(corpus[0], "doc_id int, text string, source string, cut boolean")).filter(F.col("cut"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_repeated_capitalised_pieces_are_no_closing(spark, corpus):
    rows = list(corpus[0])
    rows += [(20000 + 10000 * k + i, text, s, c) for k in range(24) for i, text, s, c in corpus[0]]
    rng = random.Random(12)
    for i in range(400):  # the saint's name goes on, or the text is cut in it
        rows.append((6000 + i, f"{sentence(rng)} My aunt praised the silver kettle on the feast of Saint Orrin before the harvest. {sentence(rng)}", "saints", True))
    for i in range(7):
        rows.append((7000 + i, f"{' '.join(sentence(rng) for _ in range(i + 1))} My aunt praised the silver kettle on the feast of Saint Orr", "saints", True))
    for i in range(60):
        rows.append((8000 + i, f"{' '.join(sentence(rng) for _ in range(i % 5 + 1))}\n\nLaus Deo", "printer", True))
    out = {r.doc_id: r.cut for r in cut_off(spark.createDataFrame(rows, "doc_id int, text string, source string, cut boolean")).collect()}
    assert all(out[7000 + i] for i in range(7)) and not any(out[8000 + i] for i in range(60))
