"""Features, groups and the tests between them, in long form."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.runtime import Workspace, small

#: Parts into which one of two lists of names is dealt when every name of one meets every name of the other.
BLOCKS = 64


# ---- features -------------------------------------------------------------------------------


def expand_booleans(rows: DataFrame, key: Sequence[str], fields: Mapping[str, str], prefix: str = "", joint: str = ":") -> DataFrame:
    """(key, feature): one row per true boolean, list item or enum value; names are prefix + field [+ joint + value].

    fields: name -> bool, enum or list. Only values that occur give features.
    """
    parts = []
    for f, kind in fields.items():
        c = F.col(f)
        if kind == "bool":
            parts.append(F.when(c.cast("boolean"), F.array(F.lit(prefix + f))).otherwise(F.array().cast("array<string>")))
        elif kind == "enum":
            parts.append(F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(prefix + f + joint), c))).otherwise(F.array().cast("array<string>")))
        else:
            parts.append(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit(prefix + f + joint), x)))
    return rows.select(*key, F.explode(F.array_distinct(F.concat(*parts))).alias("feature")).distinct()


def expand_mixed(rows: DataFrame, key: Sequence[str], fields: Mapping[str, str], ordinals: Mapping[str, Mapping[str, int]], prefix: str = "") -> DataFrame:
    """(key, feature, value): booleans and labels as 0/1 features with `__`, ordered enums as their rank (-1 unknown)."""
    plain = {f: k for f, k in fields.items() if f not in ordinals}
    ones = expand_booleans(rows, key, plain, prefix, "__").withColumn("value", F.lit(1.0))
    for f, ranks in ordinals.items():
        table = F.create_map(*[F.lit(x) for p in ranks.items() for x in p])
        rank = F.coalesce(F.try_element_at(table, F.col(f)), F.lit(-1)).cast("double")
        ones = ones.unionByName(rows.select(*key, F.lit(prefix + f).alias("feature"), rank.alias("value")))
    return ones


def joint_features(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Features of the keys that every frame has, in long form (an inner join of wide matrices without their width)."""
    tagged = None
    for i, f in enumerate(frames):
        part = f.withColumn("_task", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    whole = tagged.groupBy(*key).agg(F.count_distinct("_task").alias("_n")).filter(F.col("_n") == len(frames)).select(*key)
    return tagged.join(whole, list(key), "left_semi").drop("_task")


def extras(tags: DataFrame, key: str, tag: str, names: Sequence[str], prefix: str = "genre_") -> DataFrame:
    """One 0/1 column per given tag."""
    wide = tags.select(key, tag).distinct().groupBy(key).pivot(tag, list(names)).agg(F.lit(1))
    return wide.select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(prefix + n.replace(" ", "_")) for n in names])


# ---- groups ---------------------------------------------------------------------------------


def groups(texts: DataFrame, tags: DataFrame, key: str, year: Column, tag: str = "tag", least: int = 30) -> DataFrame:
    """(key, grp, kind) for tags, unordered pairs of tags, half centuries and half centuries within tags, from `least` members on.

    Single tags are pruned by support before pairs are made: a pair has no more members than either tag.
    """
    from folioscope.functions.text import half_century

    space = Workspace(tags.sparkSession, "groups")
    base = space.keep(tags.select(key, F.col(tag).alias("t")).filter("t IS NOT NULL").distinct())
    often = space.keep(base.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("t"))
    kept = base.join(small(often), "t", "left_semi")
    single = kept.select(key, F.col("t").alias("grp"), F.lit("tag").alias("kind"))
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("ts")).filter(F.size("ts") > 1)
    firsts = listed.select(key, "ts", F.posexplode("ts").alias("i", "a"))
    pairs = firsts.select(key, "a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b")).select(key, F.concat("a", F.lit("+"), "b").alias("grp"), F.lit("tag_pair").alias("kind"))
    era = texts.select(key, half_century(year).alias("h")).filter("h IS NOT NULL").distinct()
    halves = era.select(key, F.col("h").alias("grp"), F.lit("halfcent").alias("kind"))
    crossed = era.join(kept, key).select(key, F.concat("h", F.lit("|"), "t").alias("grp"), F.lit("halfcent_tag").alias("kind"))
    every = space.keep(single.unionByName(pairs).unionByName(halves).unionByName(crossed))
    sizes = space.keep(every.groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("kind", "grp"))
    return every.join(small(sizes), ["kind", "grp"], "left_semi").select(key, "grp", "kind")


# ---- contingency and exact tests ------------------------------------------------------------


def contingency(features: DataFrame, members: DataFrame, key: Sequence[str], least_group: int = 30, least_feature: int = 20) -> DataFrame:
    """(grp, kind, feature, a, b, c, d) on the keys that both frames have; every pair of frequent group and feature, a = 0 too.

    The pairs of dimension values that survive their minimum sizes are the result itself; they are made from
    the two lists of names, one of them dealt into blocks, so no list is held in one row and none is
    broadcast unless its written size is small.
    """
    space = Workspace(features.sparkSession, "contingency")
    f, g = space.keep(features.select(*key, "feature").distinct()), space.keep(members.select(*key, "grp", "kind").distinct())
    shared = space.keep(f.select(*key).join(g.select(*key), list(key), "left_semi").distinct())
    f, g = space.keep(f.join(small(shared), list(key), "left_semi")), space.keep(g.join(small(shared), list(key), "left_semi"))
    n = shared.count()
    nf = space.keep(f.groupBy("feature").agg(F.count(F.lit(1)).alias("nf")).filter(F.col("nf") >= least_feature))
    ng = space.keep(g.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("ng")).filter(F.col("ng") >= least_group))
    both = f.join(small(nf.select("feature"), of=nf), "feature", "left_semi").join(g.join(small(ng.select("grp", "kind"), of=ng), ["grp", "kind"], "left_semi"), list(key)).groupBy("grp", "kind", "feature").agg(F.count(F.lit(1)).alias("a"))
    out = _every_pair(ng, nf.select("feature", "nf")).join(both, ["grp", "kind", "feature"], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("bigint")))
    return out.select("grp", "kind", "feature", "a", (F.col("ng") - F.col("a")).alias("b"), (F.col("nf") - F.col("a")).alias("c"), (F.lit(n) - F.col("ng") - F.col("nf") + F.col("a")).alias("d"))


def _every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of `left` beside every row of `right`: right is dealt into blocks, left goes to each block, and the blocks are joined."""
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(BLOCKS)).cast("int"))
    return left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).join(dealt, "_block").drop("_block")


def feature_pairs(features: DataFrame, key: Sequence[str], least: int = 20, across: bool = True) -> DataFrame:
    """(feature_a, feature_b, a, b, c, d) for pairs of frequent features in name order; `across`: only of different tasks (the part before the dot)."""
    space = Workspace(features.sparkSession, "pairs")
    f = space.keep(features.select(*key, "feature").distinct())
    n = f.select(*key).distinct().count()
    nf = space.keep(f.groupBy("feature").agg(F.count(F.lit(1)).alias("nf")).filter(F.col("nf") >= least))
    kept = f.join(small(nf.select("feature"), of=nf), "feature", "left_semi")
    listed = kept.groupBy(*key).agg(F.array_sort(F.collect_set("feature")).alias("fs"))
    firsts = listed.select("fs", F.posexplode("fs").alias("i", "feature_a"))
    both = firsts.select("feature_a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("feature_b")).groupBy("feature_a", "feature_b").agg(F.count(F.lit(1)).alias("a"))
    pairs = _every_pair(nf.toDF("feature_a", "na"), nf.toDF("feature_b", "nb")).filter("feature_a < feature_b")
    if across:
        pairs = pairs.filter(F.substring_index("feature_a", ".", 1) != F.substring_index("feature_b", ".", 1))
    out = pairs.join(both, ["feature_a", "feature_b"], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("bigint")))
    return out.select("feature_a", "feature_b", "a", (F.col("na") - F.col("a")).alias("b"), (F.col("nb") - F.col("a")).alias("c"), (F.lit(n) - F.col("na") - F.col("nb") + F.col("a")).alias("d"))


def odds_and_rates(tables: DataFrame) -> DataFrame:
    """Adds odds (infinite where b or c is 0), rate in and outside the group (null on an empty side); tables with b = c = 0 are left out."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return tables.filter("NOT (b = 0 AND c = 0)").withColumns({
        "odds": F.when(b * c == 0, F.lit(math.inf)).otherwise(a * d / F.nullif(b * c, F.lit(0.0))), "rate_in": a / F.nullif(a + b, F.lit(0.0)), "rate_out": c / F.nullif(c + d, F.lit(0.0)),
    })


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln(n!) by the Stirling series, shifted for small n; relative error below 1e-13."""
    x = n.astype(float) + 1
    low = x < 16
    y = np.where(low, x + 16, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    if low.any():
        steps = x[low, None] + np.arange(16)
        series[low] -= np.log(steps).sum(1)
    return series


def exact_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided probability of a 2 x 2 table: the sum over all tables with its margins that are no likelier.

    Tables more than 45 deviations from both the mode and the table itself are each less likely than
    exp(-900), which a double can't hold; the sum goes over all others.
    """
    r, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, a - d), min(r, k)
    mean = r * k / max(1, n)
    reach = 45 * math.sqrt(max(1.0, mean * (1 - k / max(1, n)) * (n - r) / max(1, n - 1))) + 50
    near = [(max(low, int(z - reach)), min(high, int(z + reach))) for z in (mean, a)]
    (x0, x1), (y0, y1) = sorted(near)
    xs = np.arange(x0, max(x1, y1) + 1) if y0 <= x1 + 1 else np.concatenate([np.arange(x0, x1 + 1), np.arange(y0, y1 + 1)])
    m = len(xs)
    logs = _log_factorial(np.concatenate([xs, r - xs, k - xs, n - r - k + xs, [r, n - r, k, n - k, n]]))
    lp = logs[4 * m : 4 * m + 4].sum() - logs[-1] - logs[: 4 * m].reshape(4, m).sum(0)
    seen = lp[np.searchsorted(xs, a)] + 1e-7
    return float(min(1.0, np.exp(lp[lp <= seen]).sum()))


def fisher(tables: DataFrame) -> DataFrame:
    """Adds p_value, the two-sided exact probability of a table (a, b, c, d) with all tables no likelier.

    Built-in expressions have no log-gamma and step through a sum one value at a time; a table here is
    one vector operation in an Arrow batch, and its number is that of the dimension pairs, not of rows.
    """

    @F.pandas_udf(DoubleType())
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([exact_p(*map(int, t)) for t in zip(a, b, c, d)], dtype=float)

    # the tables are few and each is work: deal them out evenly, which adaptive coalescing wouldn't
    return tables.repartition(tables.sparkSession.sparkContext.defaultParallelism).withColumn("p_value", p("a", "b", "c", "d"))


def benjamini_hochberg(tests: DataFrame, p: str, hypotheses: int | None = None) -> DataFrame:
    """Adds q_value: p n / rank, then the running minimum from the largest p down; n is the number of non-null p or `hypotheses`.

    The rank of a p-value is the number of p-values that are not greater. No task sorts all tests: p-values
    fall into narrow bins of their logarithm, the running minimum goes over the at most 4,000 bins, and inside
    each bin over its own distinct values. A null p has a null q.
    """
    space = Workspace(tests.sparkSession, "discovery")
    bin_ = F.floor(F.greatest(F.log(F.greatest(F.col(p).cast("double"), F.lit(1e-300))), F.lit(-700.0)) * 5.7).cast("int")
    binned = tests.withColumn("_bin", bin_)
    values = space.keep(binned.filter(F.col(p).isNotNull()).groupBy("_bin", p).agg(F.count(F.lit(1)).alias("_c")))
    bins = space.keep(values.groupBy("_bin").agg(F.sum("_c").alias("_n")))
    n = F.lit(float(hypotheses)) if hypotheses is not None else F.lit(float(bins.agg(F.sum("_n")).first()[0] or 0))
    before = bins.select("_bin", F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy(p)
    ranked = values.join(small(before, of=bins), "_bin").withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    q = ranked.withColumn("_q", F.least(F.lit(1.0), F.col(p) * F.greatest(n, F.lit(1.0)) / F.col("_rank")))
    q = space.keep(q.withColumn("_own", F.min("_q").over(inside.rowsBetween(0, Window.unboundedFollowing))).select("_bin", p, "_q", "_own"))
    least = q.groupBy("_bin").agg(F.min("_q").alias("_m"))
    later = least.select("_bin", F.min("_m").over(Window.orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    final = q.join(small(later, of=bins), "_bin").select(F.col("_bin"), F.col(p), F.least("_own", F.coalesce("_later", F.lit(1.0))).alias("q_value"))
    return binned.join(small(final, of=q), ["_bin", p], "left").drop("_bin")


def discriminate(features: DataFrame, members: DataFrame, key: Sequence[str], least_group: int = 30, least_feature: int = 20) -> DataFrame:
    """Every frequent group against every frequent feature: table, odds, rates, exact p and q."""
    tables = odds_and_rates(contingency(features, members, key, least_group, least_feature))
    return benjamini_hochberg(Workspace(features.sparkSession, "tests").keep(fisher(tables)), "p_value")


def report(tests: DataFrame, kind: str, alpha: float, top: int, ties: Sequence[str]) -> DataFrame:
    """The `top` tests with the smallest q of each kind, below alpha."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy("q_value", "p_value", *ties))
    return tests.filter(F.col("q_value") < alpha).withColumn("rank", rank).filter(F.col("rank") <= top)


# ---- descriptive statistics -----------------------------------------------------------------


def gini(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of the values of each group; 0 for fewer than two values or a sum of 0."""
    w = Window.partitionBy(*by).orderBy(value)
    r = values.withColumn("_r", F.row_number().over(w))
    n, s = F.count(F.lit(1)), F.sum(value)
    return r.groupBy(*by).agg(F.when((n < 2) | (s == 0), 0.0).otherwise(2 * F.sum(F.col("_r") * F.col(value)) / (n * F.nullif(s, F.lit(0))) - (n + 1) / n).alias("gini"))


def residualize(rows: DataFrame, by: Sequence[str], size: str, metrics: Sequence[str], least: int = 5) -> DataFrame:
    """Adds metric_resid: what a line on ln(1 + size) leaves of each metric within `by`; null below `least` complete rows."""
    w = Window.partitionBy(*by)
    x = F.log1p(F.col(size).cast("double"))
    out = {}
    for m in metrics:
        y = F.col(m).cast("double")
        n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
        slope, cut = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
        out[f"{m}_resid"] = F.when(n >= least, y - (cut + slope * x))
    return rows.withColumns(out)


def coverage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n, filled, share) of non-empty values, in one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    return one.select("n", F.inline(cells)).select("field", "n", "filled", (F.col("filled") / F.nullif("n", F.lit(0))).alias("share"))


def value_counts(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values by how often they occur, ties by value."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(top) if top else counted


def presence_rates(rows: DataFrame, label: str, items: str, labels: Sequence[str], top: int = 12) -> DataFrame:
    """Share of the rows of each label that hold an item, one column per label, and the spread between labels; the `top` widest."""
    totals = rows.groupBy(label).agg(F.count(F.lit(1)).alias("total"))
    seen = rows.select(label, F.explode(F.array_distinct(items)).alias("item")).groupBy(label, "item").agg(F.count(F.lit(1)).alias("n"))
    rates = seen.join(totals, label).withColumn("rate", F.col("n") / F.col("total"))
    wide = rates.groupBy("item").pivot(label, list(labels)).agg(F.first("rate"))
    wide = wide.select("item", *[F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).alias(f"rate_{x}") for x in labels])
    columns = [F.col(f"`rate_{x}`") for x in labels]
    wide = wide.withColumn("spread", F.greatest(*columns) - F.least(*columns))
    return wide.orderBy(F.desc("spread"), "item").limit(top)


def cross_language(facts: DataFrame, texts: DataFrame, specs: Sequence[Mapping[str, str | None]], breaks: Sequence[int], prose: DataFrame | None = None) -> DataFrame:
    """(lang, label, period, n, n_true, pct): how often a field, or an element of a list field, is true by language and period.

    prose: (_id, scheme, seq, flag); passages with a flag that isn't 'true' are left out, those without one stay.
    """
    from folioscope.functions.text import period_bin, truthy

    spark = facts.sparkSession
    spec = spark.createDataFrame([(s["field"], s.get("element"), s["label"]) for s in specs], "field string, element string, label string")
    rows = facts.join(F.broadcast(spec), "field")
    if prose is not None:
        flags = prose.groupBy("_id", "scheme", "seq").agg(F.min((F.col("flag") == "true").cast("int")).alias("_p"))
        rows = rows.join(flags, ["_id", "scheme", "seq"], "left").filter(F.coalesce("_p", F.lit(1)) == 1)
    dated = texts.select("_id", "lang", period_bin(F.col("year"), breaks).alias("period")).filter("period IS NOT NULL AND lang IS NOT NULL")
    listed = F.coalesce(F.array_contains(F.from_json("value", "array<string>"), F.col("element")), F.lit(False))
    hit = F.when(F.col("element").isNull(), truthy(F.col("value"))).otherwise(listed)
    out = rows.withColumn("_t", hit).join(dated, "_id").groupBy("lang", "label", "period").agg(F.count(F.lit(1)).alias("n"), F.count_if("_t").alias("n_true"))
    return out.withColumn("pct", F.bround(F.lit(100.0) * F.col("n_true") / F.col("n"), 1))


def partition_r2(rows: DataFrame, response: str, predictors: Mapping[str, Sequence[str]]) -> DataFrame:
    """(grp, n_features, marginal_r2, unique_r2, full_r2): variance of an array response explained by groups of columns.

    One pass sums the cross products of all columns; the regressions are solved from that small matrix on
    the driver (columns squared, checked), by minimum norm where columns are dependent.
    """
    columns = [c for cs in predictors.values() for c in cs]
    width = rows.select(F.size(response)).first()
    if width is None:
        return rows.sparkSession.createDataFrame([], "grp string, n_features int, marginal_r2 double, unique_r2 double, full_r2 double")
    m = len(columns) + width[0]
    if m > 4096:
        raise ValueError("more than 4,096 columns")
    names = columns

    def gram(frames):
        total = np.zeros((m + 1, m + 1))
        for f in frames:
            y = np.stack([np.asarray(v, dtype=float) for v in f[response]])
            z = np.hstack([np.ones((len(f), 1)), f[names].to_numpy(float), y])
            total += z.T @ z
        yield pd.DataFrame([(i, total[i].tolist()) for i in range(m + 1)], columns=["i", "row"])

    parts = rows.select(*columns, response).mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((m + 1, m + 1))
    for i, j, x in parts:
        g[i, j] = x
    n = g[0, 0]
    mean = g[0] / n
    cov = g / n - np.outer(mean, mean)
    at = {c: i + 1 for i, c in enumerate(columns)}
    ys = slice(len(columns) + 1, m + 1)
    total = np.trace(cov[ys, ys])

    def r2(cs: Sequence[str]) -> float:
        ix = [at[c] for c in cs if cov[at[c], at[c]] > 1e-12]
        if not ix or total <= 0:
            return 0.0
        s = np.sqrt(np.diag(cov)[ix])
        xx, xy = cov[np.ix_(ix, ix)] / np.outer(s, s), cov[ix, ys] / s[:, None]
        return float(np.trace(xy.T @ np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ xy) / total)

    full = r2(columns)
    out = [(k, len(cs), r2(cs), full - r2([c for c in columns if c not in set(cs)]), full) for k, cs in predictors.items()]
    return rows.sparkSession.createDataFrame(out, "grp string, n_features int, marginal_r2 double, unique_r2 double, full_r2 double")


def means_by_decade(rows: DataFrame, year: str, metrics: Sequence[str]) -> DataFrame:
    """(decade, n, means of the metrics); rows without a year are left out."""
    decade = (F.floor(F.col(year) / 10) * 10).cast("bigint").alias("decade")
    return rows.filter(F.col(year).isNotNull()).groupBy(decade).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def means_by_tag(rows: DataFrame, tags: str, metrics: Sequence[str], joint: str = ";", top: int = 10) -> DataFrame:
    """(tag, n, means of the metrics) of the `top` most frequent tags of a text of tags, ties by name."""
    each = rows.select(F.explode(F.array_distinct(F.transform(F.split(F.coalesce(tags, F.lit("")), joint), lambda x: F.trim(x)))).alias("tag"), *metrics).filter("tag <> ''")
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]).orderBy(F.desc("n"), "tag").limit(top)


def correlations(rows: DataFrame, size: str, metrics: Sequence[str], least: int = 5) -> DataFrame:
    """(metric, n, r): Pearson's correlation of each metric with ln(1 + size) over complete rows; only from more than `least` of them."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics])
    each = rows.select(F.log1p(F.col(size).cast("double")).alias("x"), F.inline(cells)).filter("x IS NOT NULL AND y IS NOT NULL")
    return each.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r")).filter(F.col("n") > least)


def group_matrix(members: DataFrame, key: Sequence[str], group: str, groups: Sequence[str], value: str | None = None) -> DataFrame:
    """One column per group: whether a member is in it, or with `value` the greatest value it has there (null where it is in none)."""
    if value is None:
        wide = members.select(*key, group).distinct().groupBy(*key).pivot(group, list(groups)).agg(F.lit(True))
        return wide.select(*key, *[F.coalesce(F.col(f"`{g}`"), F.lit(False)).alias(g) for g in groups])
    return members.groupBy(*key).pivot(group, list(groups)).agg(F.max(value))
