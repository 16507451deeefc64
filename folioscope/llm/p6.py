"""Problem 6: items that appear together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.values import name_key
from folioscope.operators.stats import benjamini_hochberg
from folioscope.runtime import Workspace, read, small

#: Frequencies and sizes up to FINE are a bin each in the histograms of the fit; above it a bin is a hundredth wide.
FINE = 128
#: Items of a basket that one row of the making of pairs holds; a longer basket is dealt out in blocks of two such parts.
PART = 256


def baskets_of(records: DataFrame, keys: list[str], items: str) -> DataFrame:
    """(keys, basket): the sorted distinct item keys of each distinct record; records with a null list don't count.

    Repeated records are one record that holds the items of all its copies.
    """
    listed = records.filter(F.col(items).isNotNull()).select(*keys, F.transform(items, name_key).alias("_b"))
    merged = listed.groupBy(*keys).agg(F.flatten(F.collect_set("_b")).alias("_b"))
    return merged.select(*keys, F.array_sort(F.filter(F.array_distinct("_b"), lambda x: x.isNotNull() & (x != ""))).alias("basket"))


def written_forms(records: DataFrame, items: str, joint: str) -> DataFrame:
    """(item, label): one written form per item key - lower case, `joint` between words.

    Of several ways to divide the same letters into words the most frequent one is taken, of equally
    frequent ones the smallest.
    """
    spelled = records.select(F.explode(items).alias("s")).filter(F.col("s").isNotNull())
    words = F.regexp_replace(F.regexp_replace(F.lower("s"), r"[^\p{L}\p{N}]+", joint), rf"^{joint}|{joint}$", "")
    counted = spelled.select(words.alias("label")).groupBy("label").count().withColumn("item", name_key(F.col("label"))).filter("item <> ''")
    return counted.groupBy("item").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"))


def fit_null(degrees: np.ndarray, degree_items: np.ndarray, sizes: np.ndarray, size_records: np.ndarray, rounds: int = 2000, close: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses x (per item frequency) and y (per basket size) of the bipartite configuration model.

    The chance that item i is in record r is x_i y_r / (1 + x_i y_r), such that every item has its
    frequency and every record its size in expectation. Items of one frequency share x and records of
    one size share y, so the model is fitted on the two histograms, whose bins bound their lengths
    (about 2,500 up to a million million), whatever the number of items and records.
    """
    total = float((degrees * degree_items).sum())
    if total == 0:
        return np.zeros(len(degrees)), np.zeros(len(sizes))
    x, y = degrees / np.sqrt(total), sizes / np.sqrt(total)
    full = degree_items.sum()
    for _ in range(rounds):
        xy = 1 + np.outer(x, y)
        nx = degrees / np.maximum(((size_records * y) / xy).sum(1), 1e-300)
        xy = 1 + np.outer(nx, y)
        ny = sizes / np.maximum(((degree_items * nx)[:, None] / xy).sum(0), 1e-300)
        # a record that holds every item, or an item in every record, has an infinite fitness
        nx, ny = np.minimum(nx, 1e9), np.minimum(np.where(sizes >= full, 1e9, ny), 1e9)
        step = max(np.abs(np.log(np.maximum(nx, 1e-300) / np.maximum(x, 1e-300))).max(), np.abs(np.log(np.maximum(ny, 1e-300) / np.maximum(y, 1e-300))).max())
        x, y = nx, ny
        if step < close:
            break
    return x, y


def fitness(count: float, y: np.ndarray, records: np.ndarray) -> float:
    """The x of an item that is in `count` records: the root of sum x y / (1 + x y) = count, which Newton's method on ln x finds."""
    low, high, t = -60.0, 60.0, 0.0
    for _ in range(200):
        p = np.exp(t) * y / (1 + np.exp(t) * y)
        miss = float((records * p).sum()) - count
        low, high = (low, t) if miss > 0 else (t, high)
        slope = float((records * p * (1 - p)).sum())
        new = t - miss / slope if slope > 0 else (low + high) / 2
        new = new if low < new < high else (low + high) / 2
        if abs(new - t) < 1e-12:
            break
        t = new
    return float(np.exp(t))


def tail(q: np.ndarray, n: np.ndarray, k: int) -> float:
    """P(X >= k) for the sum X of n_s independent trials of chance q_s each (Poisson-binomial).

    The trials are tilted until k is their mean; the tilted distribution is the inverse Fourier transform of
    its characteristic function, whose length follows its deviation (24 of them, beyond which less than
    1e-30 lies), and the tail is its sum with the tilt taken back. So the result keeps its relative
    precision however small it is, and the cost grows with the deviation, not with the number of trials.
    """
    q, n = q[n > 0], n[n > 0]
    if k <= 0:
        return 1.0
    if k > n.sum():
        return 0.0
    if k == n.sum():
        return float(np.exp((n * np.log(np.maximum(q, 1e-300))).sum()))
    q = np.clip(q, 1e-300, 1 - 1e-16)
    low, high, t = -750.0, 750.0, 0.0
    for _ in range(200):
        e = q * np.exp(t)
        p = np.where(np.isfinite(e), e / (1 - q + e), 1.0)
        miss = float((n * p).sum()) - k
        low, high = (low, t) if miss > 0 else (t, high)
        variance = float((n * p * (1 - p)).sum())
        new = t - miss / variance if variance > 0 else (low + high) / 2
        new = new if low < new < high else (low + high) / 2
        if abs(new - t) < 1e-13 * max(1.0, abs(t)):
            break
        t = new
    e = q * np.exp(t)
    p = e / (1 - q + e)
    length = 1 << int(np.ceil(np.log2(24 * np.sqrt(max(float((n * p * (1 - p)).sum()), 1.0)) + 64)))
    angle = 2 * np.pi * np.arange(length) / length
    log = -1j * k * angle
    for chance, trials in zip(p, n):
        log = log + trials * np.log1p(chance * (np.exp(1j * angle) - 1))
    mass = np.maximum(np.fft.fft(np.exp(log)).real / length, 0.0)
    generated = float((n * np.log1p(q * np.expm1(t))).sum()) - t * k
    half = length // 2
    if t >= 0:
        return float(min(1.0, np.exp(generated + np.log(max((mass[:half] * np.exp(-t * np.arange(half))).sum(), 1e-300)))))
    below = np.arange(1, half + 1)
    return float(min(1.0, max(0.0, 1 - np.exp(generated + np.log(max((mass[-below] * np.exp(t * below)).sum(), 1e-300))))))


def _histogram(counted: DataFrame, value: str, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and total weight of each bin of a histogram; its length is bounded by the bins, whatever the table."""
    wide = F.lit(FINE) + F.floor(F.log(F.col(value) / F.lit(float(FINE))) / F.lit(0.01))
    bins = counted.groupBy(F.when(F.col(value) <= FINE, F.col(value)).otherwise(wide).cast("int").alias("bin")).agg(F.sum(weight).alias("w"), (F.sum(F.col(value) * weight) / F.sum(weight)).alias("v"))
    rows = bins.orderBy("bin").toPandas()
    return rows["v"].to_numpy(float), rows["w"].to_numpy(float)


def _pairs_of(kinds: DataFrame) -> DataFrame:
    """(w, item_a, item_b) for the pairs of items of each basket, item_a < item_b.

    A basket is cut into parts of PART items; a row makes the pairs between two parts, so no row makes more
    than PART squared, and the rows of long baskets are dealt out over all tasks.
    """
    parts = F.ceil(F.size("b") / F.lit(PART)).cast("int")
    cut = lambda i: F.slice("b", i * PART + 1, F.lit(PART))
    short = kinds.filter((F.size("b") > 1) & (F.size("b") <= PART)).select("w", F.col("b").alias("x"), F.col("b").alias("y"))
    long = kinds.filter(F.size("b") > PART).select("w", "b", parts.alias("m"))
    firsts = long.select("w", "b", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    blocks = firsts.select("w", "b", "i", F.explode(F.sequence("i", F.col("m") - 1)).alias("j")).select("w", cut(F.col("i")).alias("x"), cut(F.col("j")).alias("y"))
    blocks = blocks.repartition(F.xxhash64("x", "y"))
    every = short.unionByName(blocks).select("w", "y", F.explode("x").alias("item_a"))
    return every.select("w", "item_a", F.explode(F.filter("y", lambda z: z > F.col("item_a"))).alias("item_b"))


def together(baskets: DataFrame, basket: str = "basket", least: int = 1) -> DataFrame:
    """One row per pair of items that occur together at least `least` times, item_a < item_b:
    n_both, n_a, n_b, records, lift, expected (under the null), p_value and q_value.

    Equal baskets are first merged into one with a weight, so a popular basket costs one row however
    often it occurs; items that occur fewer than `least` times are removed before pairs are made, which
    loses no pair. Counts are exact. The chance of at least n_both joint records is the tail of a
    Poisson-binomial under the fitted configuration model, which honours both the frequency of each item
    and the size of each basket; q_value is the Benjamini-Hochberg rate over all pairs of items.

    Defined cases: a null or empty basket holds nothing but an empty one counts as a record; no pair
    gives an empty table; ties have equal values. Other columns are ignored.
    """
    spark = baskets.sparkSession
    space = Workspace(spark, "together")
    kinds = space.keep(baskets.filter(F.col(basket).isNotNull()).groupBy(F.col(basket).alias("b")).agg(F.count(F.lit(1)).alias("w")))
    records = kinds.agg(F.sum("w")).first()[0] or 0
    items = space.keep(kinds.select(F.explode("b").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n")))
    degrees, degree_items = _histogram(items, "n", F.lit(1))
    sizes, each = _histogram(kinds.filter(F.size("b") > 0).select(F.size("b").cast("bigint").alias("s"), "w"), "s", F.col("w"))
    _, y = fit_null(degrees, degree_items, sizes, each)
    n_items = int(degree_items.sum())
    tests = n_items * (n_items - 1) // 2
    kept = kinds.select("b", "w")
    if least > 1:
        frequent = items.filter(F.col("n") >= least).select("item")
        alive = kinds.withColumn("k", F.monotonically_increasing_id()).select("k", "w", F.explode("b").alias("item")).join(frequent, "item", "left_semi")
        kept = alive.groupBy("k", "w").agg(F.array_sort(F.collect_list("item")).alias("b")).groupBy("b").agg(F.sum("w").alias("w"))
    counted = _pairs_of(kept).groupBy("item_a", "item_b").agg(F.sum("w").alias("n_both")).filter(F.col("n_both") >= least)
    weights = small(items)
    joined = space.keep(counted.join(weights.withColumnsRenamed({"item": "item_a", "n": "n_a"}), "item_a").join(weights.withColumnsRenamed({"item": "item_b", "n": "n_b"}), "item_b"))
    # equal counts have equal tails: each combination is scored once
    cases = joined.select(F.least("n_a", "n_b").alias("low"), F.greatest("n_a", "n_b").alias("high"), "n_both").distinct()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def chance(count: int) -> np.ndarray:
            if count not in known:
                x = fitness(count, y, each)
                known[count] = x * y / (1 + x * y)
            return known[count]

        for frame in frames:
            out = []
            for low, high, both in zip(frame["low"], frame["high"], frame["n_both"]):
                q = chance(int(low)) * chance(int(high))
                out.append((float((each * q).sum()), tail(q, each, int(both))))
            yield frame.assign(expected=[e for e, _ in out], p_value=[p for _, p in out])

    scores = space.keep(cases.repartition("low", "high", "n_both").mapInPandas(score, "low bigint, high bigint, n_both bigint, expected double, p_value double"))
    scored = space.keep(joined.withColumns({"low": F.least("n_a", "n_b"), "high": F.greatest("n_a", "n_b")}).join(small(scores), ["low", "high", "n_both"]).drop("low", "high"))
    lift = F.col("n_both") * F.lit(float(records)) / (F.col("n_a") * F.col("n_b"))
    return benjamini_hochberg(scored, "p_value", max(tests, 1)).select("item_a", "item_b", "n_both", "n_a", "n_b", F.lit(records).cast("bigint").alias("records"), lift.alias("lift"), "expected", "p_value", "q_value")


KINDS = {"scene_content": ("passage_content", ["_id", "scheme", "seq"], "scene_content", "_"), "genre_tags": ("genre_lite", ["_id"], "genre_tags", " ")}


def _pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    out = None
    for kind, (table, keys, items, joint) in KINDS.items():
        records = read(spark, d, table)
        pairs = together(baskets_of(records, keys, items), least=least)
        forms = written_forms(records, items, joint)
        named = pairs.join(forms.withColumnsRenamed({"item": "item_a", "label": "label_a"}), "item_a").join(forms.withColumnsRenamed({"item": "item_b", "label": "label_b"}), "item_b")
        rows = named.select(
            F.lit(kind).alias("basket"), F.least("label_a", "label_b").alias("item_a"), F.greatest("label_a", "label_b").alias("item_b"), "n_both",
            F.when(F.col("label_a") < F.col("label_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("label_a") < F.col("label_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
            "records", "lift", "expected", "p_value", "q_value",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of labels that occurs, with its counts, lift and surprise."""
    return _pairs(spark, d, 1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs as frequent, in number and share, and as far above independence as the report asks, from the counts of `together`.

    q_value isn't asked for: the cases are defined by counts, and in a table of few records it would turn most of them down.
    """
    often = (F.col("n_both") >= 5) & (F.col("n_both") * 100 >= F.col("records")) & (F.col("n_both") * F.col("records") >= 2 * F.col("n_a") * F.col("n_b"))
    return _pairs(spark, d, 5).filter(often).select("basket", "item_a", "item_b")


def _sql(select: str) -> str:
    parts = []
    for kind, (table, keys, items, joint) in KINDS.items():
        k = ", ".join(keys)
        parts.append(rf"""
SELECT '{kind}' AS basket, * FROM (WITH r AS (SELECT {k}, {items} AS l FROM {table} WHERE {items} IS NOT NULL),
n AS (SELECT count(*) AS records FROM (SELECT DISTINCT {k} FROM r)),
s AS (SELECT {k}, unnest(l) AS s FROM r),
i AS (SELECT DISTINCT {k}, regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', '', 'g') AS item FROM s WHERE s IS NOT NULL),
f AS (SELECT regexp_replace(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', '{joint}', 'g'), '^{joint}|{joint}$', '', 'g') AS label, count(*) AS c FROM s WHERE s IS NOT NULL GROUP BY 1),
w AS (SELECT regexp_replace(label, '[^\p{{L}}\p{{N}}]+', '', 'g') AS item, arg_min(label, (-c, label)) AS label FROM f GROUP BY 1 HAVING item <> ''),
v AS (SELECT {k}, label FROM i JOIN w USING (item)),
d AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
p AS (SELECT x.label AS item_a, y.label AS item_b, count(*) AS n_both FROM v x JOIN v y ON {" AND ".join(f"x.{c} = y.{c}" for c in keys)} AND x.label < y.label GROUP BY ALL)
SELECT item_a, item_b, n_both, da.n AS n_a, db.n AS n_b, records FROM p JOIN d da ON da.label = item_a JOIN d db ON db.label = item_b CROSS JOIN n)""")
    return f"SELECT {select} FROM ({' UNION ALL '.join(parts)})"


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts alone, which SQL can check."""
    return _pairs(spark, d, 1).select("basket", "item_a", "item_b", "n_both", "n_a", "n_b", "records")


QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs, "p6_counts": p6_counts}
ORACLES = {
    "p6_found": _sql("basket, item_a, item_b") + " WHERE n_both >= 5 AND n_both * 100 >= records AND n_both * records >= 2 * n_a * n_b",
    "p6_counts": _sql("*"),
}
