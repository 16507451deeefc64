"""Votes of several agents: trust, agreement, majority consensus, tiers and audits, in long form.

Votes are rows (key columns, field, agent, value) with one vote per agent, field and key; values are
text: 'true'/'false' for booleans, JSON lists of sorted labels for lists, null for no value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _labels(value: Column) -> Column:
    return F.from_json(value, "array<string>")


def trust(votes: DataFrame, key: Sequence[str], reference: str) -> DataFrame:
    """(agent, field, trust, n): how often an agent says what the reference agent says; two nulls agree. Agents that share no row have null trust and n = 0."""
    ref = votes.filter(F.col("agent") == reference).select(*key, "field", F.col("value").alias("_r"), F.lit(True).alias("_h"))
    both = votes.filter(F.col("agent") != reference).join(ref, [*key, "field"], "left")
    return both.groupBy("agent", "field").agg(F.avg(F.when(F.col("_h"), F.col("value").eqNullSafe(F.col("_r")).cast("double"))).alias("trust"), F.count("_h").alias("n"))


def pairwise(votes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(agent_a, agent_b, field, agreement, n) for every pair of agents with common rows; two nulls agree.

    The votes on one item are few (one per agent), so pairs are made inside each item's array, without a self-join.
    """
    listed = votes.groupBy(*key, "field").agg(F.array_sort(F.collect_list(F.struct("agent", "value"))).alias("v"))
    firsts = listed.select("field", "v", F.posexplode("v").alias("i", "a"))
    pairs = firsts.select("field", "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    same = F.col("a.value").eqNullSafe(F.col("b.value")).cast("double")
    return pairs.groupBy(F.col("a.agent").alias("agent_a"), F.col("b.agent").alias("agent_b"), "field").agg(F.avg(same).alias("agreement"), F.count(F.lit(1)).alias("n"))


def allowed(votes: DataFrame, reference: str, trusts: DataFrame | None = None, threshold: float | None = None, exclude: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Votes that may count: with trusts and a threshold, listed fields keep only agents that reach it (a null trust fails) and the reference; excluded (agent, field) pairs never count."""
    out = votes
    if trusts is not None and threshold is not None:
        t = trusts.select("agent", "field", "trust")
        listed = t.select("field").distinct().withColumn("_l", F.lit(True))
        joined = out.join(t, ["agent", "field"], "left").join(listed, "field", "left")
        passes = (F.col("agent") == reference) | F.col("_l").isNull() | F.coalesce(F.col("trust") >= threshold, F.lit(False))
        out = joined.filter(passes).select(*votes.columns)
    for agent, field in exclude:
        out = out.filter(~((F.col("agent") == agent) & (F.col("field") == field)))
    return out


def consensus(votes: DataFrame, key: Sequence[str], kinds: Mapping[str, str], order: Sequence[str], reference: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(key, field, value, tier, n_votes): majority consensus of every item in one aggregation.

    bool: strict majority of non-null votes; a tie goes to the reference, else to the first vote in `order`.
    enum: plurality of non-empty votes; a tie goes to the reference if it is among the tied, else to the
    smallest label. list: a label is kept if more than half of the agents with a list have it, at exactly
    half if the reference has it; an empty list is a vote. The reference's value breaks ties even where
    its vote doesn't count (`counted`: the votes that count, all by default). Tiers: no_vote, single_vote,
    unanimous, majority (some cast vote equals the winner), no_consensus; null and empty lists aren't cast.
    """
    rank = F.create_map(*[F.lit(x) for i, a in enumerate(order) for x in (a, i)]) if order else None
    place = F.coalesce(F.try_element_at(rank, F.col("agent")), F.lit(len(order))) if rank is not None else F.lit(0)
    vote = F.struct(place.alias("o"), F.col("agent").alias("agent"), F.col("value").alias("value"))
    items = (votes if counted is None else counted).groupBy(*key, "field").agg(F.array_sort(F.collect_list(vote)).alias("v"))
    if counted is not None:
        items = votes.select(*key, "field").distinct().join(items, [*key, "field"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<o:int,agent:string,value:string>>")))
    if reference:
        ref = votes.filter(F.col("agent") == reference).select(*key, "field", F.col("value").alias("_ref"))
        items = items.join(ref, [*key, "field"], "left")
    else:
        items = items.withColumn("_ref", F.lit(None).cast("string"))
    said = F.transform("v", lambda x: x["value"])
    bools = F.filter(said, lambda x: x.isNotNull())
    yes, no = F.size(F.filter(bools, lambda x: x == "true")), F.size(F.filter(bools, lambda x: x == "false"))
    by_bool = F.when(yes > no, "true").when(no > yes, "false").when(F.size(bools) == 0, None).otherwise(F.coalesce("_ref", F.get(bools, F.lit(0))))
    labels = F.filter(said, lambda x: x.isNotNull() & (x != ""))
    tally = F.transform(F.array_distinct(labels), lambda l: F.struct((-F.size(F.filter(labels, lambda x: x == l))).alias("n"), F.when(l == F.col("_ref"), 0).otherwise(1).alias("r"), l.alias("l")))
    by_enum = F.get(F.array_sort(tally), F.lit(0))["l"]
    lists = F.filter(F.transform("v", lambda x: _labels(x["value"])), lambda x: x.isNotNull())
    kept = F.filter(F.array_distinct(F.flatten(lists)), lambda l: (2 * F.size(F.filter(lists, lambda x: F.array_contains(x, l))) > F.size(lists)) | ((2 * F.size(F.filter(lists, lambda x: F.array_contains(x, l))) == F.size(lists)) & F.coalesce(F.array_contains(_labels(F.col("_ref")), l), F.lit(False))))
    by_list = F.to_json(F.array_sort(kept))
    of = lambda k: F.col("field").isin([f for f, kind in kinds.items() if kind == k])
    value = F.when(of("bool"), by_bool).when(of("list"), by_list).otherwise(by_enum)
    cast = F.filter(said, lambda x: x.isNotNull() & (x != "[]"))
    # behind a generator, so that the folds above are computed once
    rows = items.select(*key, "field", F.explode(F.array(F.struct(value.alias("value"), cast.alias("cast")))).alias("x")).select(*key, "field", "x.value", "x.cast")
    n = F.size("cast")
    tier = (
        F.when(n == 0, "no_vote").when(n == 1, "single_vote").when(F.size(F.array_distinct("cast")) == 1, "unanimous")
        .when(F.array_contains("cast", F.col("value")), "majority").otherwise("no_consensus")
    )
    return rows.select(*key, "field", "value", tier.alias("tier"), n.alias("n_votes"))


def flagged(consensus_rows: DataFrame, key: Sequence[str], tiers: Sequence[str] = ("no_consensus",)) -> DataFrame:
    """(key, flagged): whether any field of a row is in one of the tiers."""
    return consensus_rows.groupBy(*key).agg(F.bool_or(F.col("tier").isin(list(tiers))).alias("flagged"))


def audit(consensus_rows: DataFrame, votes: DataFrame, key: Sequence[str], reference: str) -> DataFrame:
    """(key, flagged): whether the consensus differs from the reference on a field where both have a value."""
    ref = votes.filter(F.col("agent") == reference).select(*key, "field", F.col("value").alias("_r"))
    joined = consensus_rows.join(ref, [*key, "field"], "left")
    return joined.groupBy(*key).agg(F.bool_or(F.coalesce(F.col("value") != F.col("_r"), F.lit(False))).alias("flagged"))


def compare(human: DataFrame, model: DataFrame, key: Sequence[str]) -> DataFrame:
    """(field, agree, disagree, total, pct) between two sets of values, compared as sorted lists or trimmed lower text."""
    form = lambda c: F.coalesce(F.array_join(F.array_sort(_labels(F.when(c.rlike(r'^\["'), c))), ","), F.lower(F.trim(c)))
    j = human.select(*key, "field", form(F.col("value")).alias("_h")).join(model.select(*key, "field", form(F.col("value")).alias("_m")), [*key, "field"])
    same = F.col("_h").eqNullSafe(F.col("_m"))
    out = j.groupBy("field").agg(F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("agree") / F.col("total"), 1))


def disagreements(votes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, field, n_values, disagree): whether the agents with a value gave more than one; lists are compared as sets."""
    form = F.coalesce(F.to_json(F.array_sort(F.array_distinct(_labels(F.when(F.col("value").rlike(r'^\["'), F.col("value")))))), F.col("value"))
    return votes.groupBy(*key, "field").agg(F.count_distinct(form).alias("n_values")).withColumn("disagree", F.col("n_values") > 1)


def to_facts(consensus_rows: DataFrame, agent: str, task: str, version: int, run: str, when: Column) -> DataFrame:
    """Consensus values as facts of family 'derived' with the tier in meta; null values are skipped."""
    meta = F.to_json(F.struct("tier", "n_votes"))
    return consensus_rows.filter("value IS NOT NULL").select("_id", "scheme", "seq", "field", "value", F.lit("derived").alias("source_family"), F.lit(agent).alias("source_agent"), F.lit(task).alias("task"), F.lit(version).alias("task_version"), F.lit(run).alias("run_id"), when.alias("annotated_at"), meta.alias("meta"))


def presentation(human: DataFrame, models: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, results, default_model): what each model said about an item as a map; the default model is the one with most items."""
    count = models.groupBy("agent").agg(F.count(F.lit(1)).alias("n"))
    best = count.agg(F.max_by("agent", F.struct("n", "agent"))).first()[0]  # one name
    per = models.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "value")))).alias("results"))
    return per.join(human.select(*key).distinct(), list(key), "left_semi").withColumn("default_model", F.lit(best))


def even_order(rows: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows in a seeded order that every run repeats."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def first_seen_rank(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(by, value, rank): values in the order in which they first occur."""
    seen = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_o"))
    return seen.select(*by, value, F.dense_rank().over(Window.partitionBy(*by).orderBy("_o", value)).alias("rank"))
