"""Groups of linked records against union-find."""

import random

import pytest

from folioscope.llm.groups import boruvka, stars


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def cases():
    rng = random.Random(7)
    yield [(i, i + 1) for i in range(60)]  # a chain
    yield [(0, i) for i in range(1, 80)] + [(100, 101)]  # a hot hub
    yield [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    yield [(3, 3), (None, 1), (2, None), (5, 4), (4, 5), (5, 4)]
    yield []


@pytest.mark.parametrize("op", [boruvka, stars])
@pytest.mark.parametrize("pairs", list(cases()))
def test_against_union_find(spark, op, pairs):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a bigint, b bigint, root string")
    got = {r.member: r.root for r in op(df, "a", "b").collect()}
    assert got == brute(pairs)


def test_struct_ends(spark):
    df = spark.createDataFrame([(("w", 2), ("w", 1)), (("v", 2), ("v", 3))], "a struct<w:string,n:int>, b struct<w:string,n:int>")
    assert {(r.member.w, r.member.n, r.root.n) for r in boruvka(df, "a", "b").collect()} == {("w", 1, 1), ("w", 2, 1), ("v", 2, 2), ("v", 3, 2)}
