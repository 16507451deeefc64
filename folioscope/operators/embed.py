"""Embeddings of passages: pooling, centring, and labels propagated by linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import Workspace

#: Most numbers in the curvature matrices that one pass sums up.
CURVATURE = 60_000_000
#: Rows of a bucket within which folds are dealt out.
BUCKET = 1000
GRID = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    n = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    return F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))


def mean_pool(passages: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, embedding): the mean of the vectors of each text, scaled to length 1. Sums are partial aggregates per dimension."""
    parts = passages.select(key, F.posexplode(embedding).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return parts.groupBy(key).agg(vector.alias("_v")).select(key, unit(F.col("_v")).alias(embedding))


def center(rows: DataFrame, group: str, embedding: str) -> DataFrame:
    """Rows with the mean of their group taken off each vector, scaled to length 1 again."""
    means = rows.select(group, F.posexplode(embedding).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vector = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("_m"))
    joined = rows.join(vector, group)
    return joined.withColumn("_c", F.zip_with(embedding, "_m", lambda x, m: x.cast("double") - m)).withColumn(embedding, unit(F.col("_c"))).select(*rows.columns)


def label_targets(rows: DataFrame, key: Sequence[str], booleans: Sequence[str], lists: dict[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """(key, targets array of 0/1) with the names of the targets: booleans, and field__label for all labels of a vocabulary, seen or not."""
    columns, names = [], []
    for f in booleans:
        columns.append(F.coalesce(F.col(f).cast("boolean"), F.lit(False)).cast("double"))
        names.append(f)
    for f, vocabulary in lists.items():
        for v in vocabulary:
            columns.append(F.coalesce(F.array_contains(f, v), F.lit(False)).cast("double"))
            names.append(f"{f}__{v}")
    return rows.select(*key, F.array(*columns).alias("targets")), names


@dataclass
class Classifiers:
    """Scaler, principal axes and one linear model per target; `folds` holds the models that were fitted without each fold."""

    targets: list[str]
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray  # dimension x axis
    weights: np.ndarray  # target x (axis + 1), the last is the intercept
    folds: np.ndarray  # fold x target x (axis + 1)

    def design(self, vectors) -> np.ndarray:
        x = (np.stack([np.asarray(v, dtype=float) for v in vectors]) - self.mean) / self.scale @ self.axes
        return np.hstack([x, np.ones((len(x), 1))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def with_folds(labelled: DataFrame, key: Sequence[str], folds: int) -> DataFrame:
    """Adds fold, an array with the fold of the row for each target: every fold has the same share of positives, up to a row in each bucket.

    Rows are dealt to buckets of about BUCKET by a hash of the key; in each bucket, target and value they are
    dealt to the folds in turn, in the order of the hash. So every run has the same folds, and no window is large.
    """
    buckets = max(1, labelled.count() // BUCKET)
    h = F.xxhash64(F.lit("fold"), *key)
    bucket = F.pmod("_h", F.lit(buckets))
    each = labelled.select(*key, h.alias("_h"), F.posexplode("targets").alias("_j", "_y"))
    turn = F.row_number().over(Window.partitionBy("_j", "_y", bucket).orderBy("_h", *key)) + bucket
    dealt = each.select(*key, F.struct("_j", F.pmod(turn, F.lit(folds)).cast("int").alias("f")).alias("x"))
    lists = dealt.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("fold"))
    return labelled.join(lists, list(key))


def principal_axes(rows: DataFrame, embedding: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, axes) of scaled vectors: at most `most` principal axes, from sums that executors add up in a tree."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vectors = rows.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("v"))
    r = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("m")).first().m
    mean, n = r.mean.toArray(), r["count"]
    var = r.variance.toArray() * (n - 1) / max(n, 1)
    scale = np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), 1.0)
    centre, width = F.array(*map(F.lit, mean.tolist())), F.array(*map(F.lit, scale.tolist()))
    scaled = F.zip_with(F.zip_with(F.col(embedding).cast("array<double>"), centre, lambda x, y: x - y), width, lambda x, y: x / y)
    axes = PCA(k=min(most, len(mean)), inputCol="v", outputCol="p").fit(rows.select(array_to_vector(scaled).alias("v"))).pc.toArray()
    return mean, scale, axes


def fit(labelled: DataFrame, key: Sequence[str], embedding: str, names: Sequence[str], folds: int = 5, penalty: float = 1.0, rounds: int = 25, close: float = 1e-6, axes: int = 100) -> Classifiers:
    """Ridge-penalised logistic regressions of all targets and all folds at once, on the first principal axes of the scaled vectors.

    labelled: (key, embedding, targets array). Every Newton iteration is one pass that sums gradients and
    curvatures, whose size is that of the models (axes squared, whatever the dimension); the sums of the
    partitions are added up by model before they come to the driver. Folds are stratified by target (see
    `with_folds`). The objective is half the squared weights plus the sum of losses / penalty; the
    intercept isn't penalised. Scaling divides by the population deviation; constant dimensions are only
    centred. The key must be unique.
    """
    first = labelled.select(F.size(embedding)).first()
    if first is None:
        raise ValueError("no labelled rows")
    d, t = min(first[0], axes), len(names)
    if (folds + 1) * t * (d + 1) ** 2 > CURVATURE:
        raise ValueError("too many targets for one pass; fit them in parts")
    space = Workspace(labelled.sparkSession, "classifiers")
    rows = space.keep(with_folds(labelled, key, folds).select(F.col(embedding).alias("x"), "targets", "fold"))
    model = Classifiers(list(names), *principal_axes(rows, "x", axes), np.zeros((t, d + 1)), np.zeros((folds, t, d + 1)))
    ridge = np.diag([1.0 / penalty] * d + [0.0])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[:1].copy()
        one["g"], one["h"] = [np.sum(group["g"].tolist(), 0)], [np.sum(group["h"].tolist(), 0)]
        return one

    for _ in range(rounds):

        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h = np.zeros((folds + 1, t, d + 1)), np.zeros((folds + 1, t, d + 1, d + 1))
            for f in frames:
                x, y, k = model.design(f["x"]), np.stack([np.asarray(v, dtype=float) for v in f["targets"]]), np.stack(f["fold"].tolist())
                for m in range(folds + 1):
                    keep = k != m
                    p = _sigmoid(x @ (model.weights if m == folds else model.folds[m]).T)
                    g[m] += ((p - y) * keep).T @ x
                    bend = p * (1 - p) * keep
                    for j in range(t):
                        h[m, j] += (x * bend[:, j, None]).T @ x
            yield pd.DataFrame([(m, j, g[m, j].tolist(), h[m, j].ravel().tolist()) for m in range(folds + 1) for j in range(t)], columns=["m", "j", "g", "h"])

        kind = "m int, j int, g array<double>, h array<double>"
        moved = 0.0
        for r in rows.mapInPandas(step, kind).groupBy("m", "j").applyInPandas(total, kind).toLocalIterator():
            w = model.weights[r.j] if r.m == folds else model.folds[r.m, r.j]
            h = np.array(r.h).reshape(d + 1, d + 1)
            change = np.linalg.solve(h + ridge + 1e-9 * np.eye(d + 1), np.array(r.g) + ridge @ w)
            w -= change
            moved = max(moved, float(np.abs(change).max()))
        if moved < close:
            break
    space.drop(rows)
    return model


def held_out(labelled: DataFrame, key: Sequence[str], embedding: str, model: Classifiers) -> DataFrame:
    """(key, target, y, p, fold): the probability that the model fitted without a row's fold gives to it."""
    folds = len(model.folds)
    rows = with_folds(labelled, key, folds).select(*key, F.col(embedding).alias("_x"), "targets", "fold")
    fields = ", ".join(f"{k} {labelled.schema[k].dataType.simpleString()}" for k in key)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = model.design(f["_x"])
            fold = np.stack(f["fold"].tolist())
            every = np.einsum("nd,mtd->nmt", x, model.folds)
            p = _sigmoid(np.take_along_axis(every, fold[:, None, :], 1)[:, 0])
            yield f[list(key)].assign(fold=f["fold"], y=f["targets"], p=p.tolist())

    scored = rows.mapInPandas(score, f"{fields}, fold array<int>, y array<double>, p array<double>")
    names = F.array(*[F.lit(x) for x in model.targets])
    return scored.select(*key, F.inline(F.arrays_zip(names.alias("target"), F.col("y"), F.col("p"), F.col("fold"))))


def evaluate(scored: DataFrame, least: float = 0.01) -> DataFrame:
    """(target, n, positive_rate, accuracy, f1, auc, note): means over folds; nearly constant targets are only named.

    The area under the curve is exact up to ties within 1e-4 of probability, which count half; it comes
    from one histogram per target and fold, not from a sort.
    """
    base = scored.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("positive_rate"))
    hit, said = F.col("y") == 1, F.col("p") >= 0.5
    per = scored.groupBy("target", "fold").agg(F.avg((hit == said).cast("double")).alias("acc"), F.count_if(hit & said).alias("tp"), F.count_if(said).alias("pp"), F.count_if(hit).alias("pos"))
    per = per.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(F.col("pp") + F.col("pos"), F.lit(0)), F.lit(0.0)))
    bins = scored.groupBy("target", "fold", F.floor(F.col("p") * 10000).alias("b")).agg(F.count_if(hit).alias("u"), F.count_if(~hit).alias("v"))
    below = F.coalesce(F.sum("v").over(Window.partitionBy("target", "fold").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = bins.withColumn("w", F.col("u") * (below + F.col("v") / 2)).groupBy("target", "fold").agg((F.sum("w") / F.nullif(F.sum("u") * F.sum("v"), F.lit(0))).alias("auc"))
    means = per.join(area, ["target", "fold"]).groupBy("target").agg(F.avg("acc").alias("accuracy"), F.avg("f1").alias("f1"), F.avg("auc").alias("auc"))
    dull = (F.col("positive_rate") < least) | (F.col("positive_rate") > 1 - least)
    return base.join(means, "target").select("target", "n", "positive_rate", *[F.when(~dull, F.col(c)).alias(c) for c in ("accuracy", "f1", "auc")], F.when(dull, "skipped: near-constant").otherwise("").alias("note"))


def calibrate(scored: DataFrame, precision: float = 0.95, least: float = 0.01) -> DataFrame:
    """(target, threshold, precision, recall, n_predicted_pos, positive_rate): the first threshold of the grid that is precise enough; targets without one are left out."""
    rates = scored.groupBy("target").agg(F.avg("y").alias("positive_rate"), F.sum("y").alias("pos")).filter(F.col("positive_rate").between(least, 1 - least))
    cuts = scored.select("target", "y", "p", F.explode(F.array(*[F.lit(t) for t in GRID])).alias("threshold")).filter("p >= threshold")
    counted = cuts.groupBy("target", "threshold").agg(F.count(F.lit(1)).alias("n_predicted_pos"), F.sum("y").alias("tp"))
    good = counted.join(rates, "target").withColumn("precision", F.col("tp") / F.col("n_predicted_pos")).withColumn("recall", F.col("tp") / F.col("pos")).filter(F.col("precision") >= precision)
    best = good.groupBy("target").agg(F.min(F.struct("threshold", "precision", "recall", "n_predicted_pos", "positive_rate")).alias("b"))
    return best.select("target", "b.*")


def trusted(report: DataFrame, accuracy: float = 0.75, f1: float = 0.5, most: int = 10_000) -> dict[str, float]:
    """Threshold 0.5 for each target whose held-out accuracy and F1 reach the bounds; for fields without a calibrated one."""
    good = report.filter((F.col("accuracy") >= accuracy) & (F.col("f1") >= f1)).select("target").orderBy("target").limit(most).collect()
    return {r.target: 0.5 for r in good}


def load(labels: DataFrame, embeddings: DataFrame, key: Sequence[str], languages: DataFrame | None = None, prefix: str = "fr", flag: str = "lang_fr") -> DataFrame:
    """Labelled rows with their vectors: the keys that both have, and with `languages` (_id, lang) a 0/1 flag, 0 where the language is unknown.

    The flag is also put at the end of each vector, as one more dimension.
    """
    joined = labels.join(embeddings, list(key))
    if languages is None:
        return joined
    known = languages.filter("lang IS NOT NULL").groupBy("_id").agg(F.min("lang").alias("_l"))
    flagged = joined.join(known, "_id", "left").withColumn(flag, F.coalesce(F.lower("_l").startswith(prefix), F.lit(False)).cast("int")).drop("_l")
    return flagged.withColumn("embedding", F.concat(F.col("embedding").cast("array<double>"), F.array(F.col(flag).cast("double"))))


def predict(pool: DataFrame, key: Sequence[str], embedding: str, model: Classifiers, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(key, target, p, predicted) for the whole pool in one scan: all models are one matrix product per batch."""
    chosen = [t for t in model.targets if thresholds is None or t in thresholds]
    index = [model.targets.index(t) for t in chosen]
    weights = model.weights[index]
    fields = ", ".join(f"{k} {pool.schema[k].dataType.simpleString()}" for k in key)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[list(key)].assign(p=_sigmoid(model.design(f["_x"]) @ weights.T).tolist())

    scored = pool.select(*key, F.col(embedding).alias("_x")).mapInPandas(score, f"{fields}, p array<double>")
    cuts = F.array(*[F.lit(float((thresholds or {}).get(t, 0.5))) for t in chosen])
    rows = scored.select(*key, F.inline(F.arrays_zip(F.array(*[F.lit(t) for t in chosen]).alias("target"), F.col("p"), cuts.alias("cut"))))
    return rows.select(*key, "target", "p", (F.col("p") >= F.col("cut")).alias("predicted"))


def to_facts(predicted: DataFrame, agent: str, task: str, version: int, run: str, when: Column) -> DataFrame:
    """Predictions as facts of family 'derived'; the probability goes into meta."""
    return predicted.select("_id", "scheme", "seq", F.col("target").alias("field"), F.col("predicted").cast("string").alias("value"), F.lit("derived").alias("source_family"), F.lit(agent).alias("source_agent"), F.lit(task).alias("task"), F.lit(version).alias("task_version"), F.lit(run).alias("run_id"), when.alias("annotated_at"), F.to_json(F.struct(F.round("p", 4).alias("p"))).alias("meta"))
