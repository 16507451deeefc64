"""Embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import embed as E
from folioscope.runtime import read


def _emb(s, d):
    return read(s, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("text_id"), "label", "embedding")


def _flat(df, key):
    return df.select(key, F.posexplode("embedding").alias("i", "x")).select(key, "i", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


def mean_pool(s, d):
    return _flat(E.mean_pool(_emb(s, d), "text_id", "embedding"), "text_id")


MEAN = """WITH p AS (SELECT vec_id // 5 AS text_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT text_id, i, avg(x) AS x FROM p GROUP BY 1, 2),
n AS (SELECT text_id, coalesce(nullif(sqrt(sum(x * x)), 0), 1) AS n FROM m GROUP BY 1) SELECT text_id, CAST(i AS INT) AS i, round((x / n)::FLOAT::DOUBLE, 4) + 0.0 AS x FROM m JOIN n USING (text_id)"""


def center_by_group(s, d):
    return _flat(E.center(_emb(s, d), "label", "embedding"), "vec_id")


CENTER = """WITH p AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2),
c AS (SELECT vec_id, i, x - m AS x FROM p JOIN m USING (label, i)), n AS (SELECT vec_id, coalesce(nullif(sqrt(sum(x * x)), 0), 1) AS n FROM c GROUP BY 1) SELECT vec_id, CAST(i AS INT) AS i, round((x / n)::FLOAT::DOUBLE, 4) + 0.0 AS x FROM c JOIN n USING (vec_id)"""


def _labelled(s, d):
    rows = _emb(s, d).withColumns({"even": F.col("embedding")[0] + F.col("embedding")[1] > 0, "tags": F.array(F.concat(F.lit("c"), F.col("label").cast("string")))})
    targets, names = E.label_targets(rows, ["vec_id", "embedding"], ["even"], {"tags": [f"c{i}" for i in range(3)] + ["never"]})
    return targets, names


def evaluate_classifiers(s, d):
    rows, names = _labelled(s, d)
    model = E.fit(rows, ["vec_id"], "embedding", names)
    return E.evaluate(E.held_out(rows, ["vec_id"], "embedding", model))


def calibrate_thresholds(s, d):
    rows, names = _labelled(s, d)
    return E.calibrate(E.held_out(rows, ["vec_id"], "embedding", E.fit(rows, ["vec_id"], "embedding", names)), 0.9)


def predict_pool(s, d):
    rows, names = _labelled(s, d)
    return E.predict(_emb(s, d), ["vec_id"], "embedding", E.fit(rows, ["vec_id"], "embedding", names), {"even": 0.5, "tags__c0": 0.7})


def load_labelled(s, d):
    e = _emb(s, d).select(F.concat(F.lit("w"), F.pmod("vec_id", F.lit(400)).cast("string")).alias("_id"), F.col("vec_id").alias("seq"), "embedding")
    labels = e.filter(F.pmod("seq", F.lit(3)) > 0).select("_id", "seq", (F.pmod("seq", F.lit(2)) == 0).alias("even"))
    languages = e.select("_id").distinct().select("_id", F.when(F.pmod(F.substring("_id", 2, 9).cast("int"), F.lit(4)) == 0, "fr").when(F.pmod(F.substring("_id", 2, 9).cast("int"), F.lit(4)) == 1, "en").alias("lang"))
    return E.load(labels, e, ["_id", "seq"], languages).select("_id", "seq", "even", "lang_fr", F.size("embedding").alias("width"))


LOAD = """SELECT 'w' || vec_id % 400 AS _id, vec_id AS seq, vec_id % 2 = 0 AS even, CAST(vec_id % 400 % 4 = 0 AS INT) AS lang_fr, CAST(len(embedding) + 1 AS INT) AS width FROM embeddings WHERE vec_id % 3 > 0"""


QUERIES = {"load_labelled": load_labelled, "mean_pool": mean_pool, "center_by_group": center_by_group, "evaluate_classifiers": evaluate_classifiers, "calibrate_thresholds": calibrate_thresholds, "predict_pool": predict_pool}
ORACLES = {"load_labelled": LOAD, "mean_pool": MEAN, "center_by_group": CENTER}
