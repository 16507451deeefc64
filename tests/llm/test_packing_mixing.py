import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.llm.mixing import mix
from folioscope.llm.packing import fill, fingerprint, pack
from folioscope.llm.tokens import encoder, with_tokens

SCHEMA = "id bigint, tokens bigint, cluster bigint, source string, container string"


def items(rng, n, hot=0.0):
    return [(i, rng.randrange(0, 300), 1 if rng.random() < hot else None if rng.random() < 0.5 else rng.randrange(10, 10 + n), rng.choice("abc"), "clash") for i in range(n)]


@pytest.mark.parametrize("hot", [0.0, 0.34])
def test_every_document_fits_and_copies_are_apart(spark, hot):
    rows = items(random.Random(1), 3000, hot) + [(9000, 0, None, None, ""), (9001, None, None, "a", ""), (9002, 1000, 7, "a", ""), (9003, 512, 7, "a", "")]
    out = pack(spark.createDataFrame(rows, SCHEMA), "id", "tokens", "cluster", "source", [("k", 512)], shard_rows=800).toPandas()
    size = {r[0]: r[1] or 0 for r in rows}
    assert out.groupby("container").tokens.sum().max() <= 512
    assert out.groupby("id").tokens.sum().to_dict() == size
    assert (out[out.id != 9002].groupby("id").size() == 1).all() and len(out[out.id == 9002]) == 2
    assert set(out[out.id == 9002].first_token) == {0, 512}
    cluster = {r[0]: r[2] for r in rows}
    whole = out[out.first_token == 0].assign(c=lambda f: f.id.map(cluster))
    assert not whole[whole.c.notna() & (whole.id != 9002)].duplicated(["container", "c"]).any()
    if not hot:
        assert sum(size.values()) / (512 * out.container.nunique()) > 0.97


def test_best_fit_against_plain_search():
    rng = random.Random(3)
    for _ in range(20):
        frame = pd.DataFrame({"size": [rng.randrange(0, 60) for _ in range(120)], "cluster": [rng.choice([None, None, 1, 2, 3]) for _ in range(120)], "source": ["a"] * 120})
        got = fill(frame, 100)
        left, held, where = [], [], {}
        order = sorted(range(120), key=lambda i: (-frame["size"][i], -(2**63) if frame.cluster[i] is None or frame.cluster[i] != frame.cluster[i] else frame.cluster[i], i))
        for i in order:
            c = frame.cluster[i]
            c = None if c is None or c != c else c
            fits = [(left[b], b) for b in range(len(left)) if left[b] >= frame["size"][i] and (c is None or c not in held[b])]
            if not fits:
                left.append(100)
                held.append(set())
                fits = [(100, len(left) - 1)]
            best = min(fits)[0]
            b = next(b for x, b in fits if x == best)
            left[b] -= frame["size"][i]
            held[b] |= {c} - {None}
        used = pd.Series(got)
        assert frame["size"].groupby(used).sum().max() <= 100
        for c in (1, 2, 3):
            assert not used[frame.cluster == c].duplicated().any()
        assert used.nunique() <= len(left) + 1


def test_exclusive_sources_and_empty(spark):
    frame = pd.DataFrame({"size": [1, 1, 1, 1], "cluster": [None] * 4, "source": ["a", "a", "b", "b"]})
    got = fill(frame, 100, frozenset({"a"}))
    assert got[0] != got[1] and got[2] == got[3]
    assert pack(spark.createDataFrame([], SCHEMA), "id", "tokens", "cluster", "source", [("k", 5)]).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], SCHEMA), "id", "tokens", "cluster", "source", [("k", 0)])


def test_tokens_of_whole_texts(spark):
    texts = ["", None, "Hello there", "word " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    e = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert {r.i: r.tokens for r in with_tokens(df, ["i"], "t").collect()} == {i: len(e.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    f = spark.createDataFrame([("A b.",), ("a  B",), ("",), (None,), ("?!",)], "t string").select(fingerprint(F.col("t"))).collect()
    assert f[0] == f[1] and [x[0] for x in f[2:]] == [None] * 3


def test_mixture_meets_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 400), s, "x") for i, s in enumerate(["big"] * 4000 + ["mid"] * 800 + ["tiny"] * 40)] + [(90001, None, "mid", ""), (90002, 0, "tiny", ""), (90003, 50, None, ""), (90004, 50, "other", "")]
    df = spark.createDataFrame(rows, "id bigint, tokens bigint, source string, rate string")
    targets = [("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.1, 5), ("absent", 0.2, 2)]
    chosen, shares = mix(df, "id", "tokens", "source", targets)
    got = {r.source: r for r in shares.collect()}
    assert got["absent"].tokens == 0
    for s, w, cap in targets[:3]:
        assert abs(got[s].reached_share - w) < 0.003 and got[s].most_copies <= cap
    assert chosen.filter("tokens = 0 OR copies < 1 OR source = 'other'").count() == 0
    tokens = sum(r[1] for r in rows if r[2] == "tiny" and r[1])
    assert got["tiny"].tokens == 5 * tokens  # the source that runs out first is used up
    assert sorted(map(tuple, chosen.select("id", "copies").collect())) == sorted(map(tuple, mix(df.repartition(7), "id", "tokens", "source", targets)[0].select("id", "copies").collect()))


def test_smaller_total_and_empty(spark):
    df = spark.createDataFrame([(i, 100, "a" if i % 2 else "b") for i in range(2000)], "id bigint, tokens bigint, source string")
    _, shares = mix(df, "id", "tokens", "source", [("a", 0.75, 2), ("b", 0.25, 2)], total=40000)
    assert {r.source: r.tokens for r in shares.collect()} == {"a": 30000, "b": 10000}
    chosen, shares = mix(df.limit(0), "id", "tokens", "source", [("a", 1.0, 1)])
    assert chosen.count() == 0 and shares.first().tokens == 0
