"""Mixing sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import Workspace

#: Steps into which the rounding of each source is sorted before the last step is settled row by row.
STEPS = 4096
#: Most sources; their multipliers are kept on the driver.
SOURCES = 10_000


def solve(histogram: DataFrame, totals: dict[str, tuple[float, float]], goals: dict[str, float], caps: dict[str, int], rounds: int = 100, close: float = 1e-9) -> dict[str, float]:
    """Multiplier of each source: documents of source s with t tokens get the rate min(cap, exp(l_s t / mean_s)).

    These rates are the ones closest to one copy each (in relative entropy) that meet the token goal of
    the source below the cap. The dual is convex and splits by source; every Newton iteration evaluates
    the tokens of all sources and their slope in one aggregate over (source, tokens, documents), and a
    step that leaves the bracket of the root is replaced by halving it. inf: every document at its cap.
    """
    spark = histogram.sparkSession
    out = {s: 0.0 for s in goals}
    bracket = {}
    for s, goal in goals.items():
        tokens, _ = totals[s]
        if goal >= caps[s] * tokens * (1 - close):
            out[s] = math.inf
        else:
            bracket[s] = [-60.0 * max(1.0, math.log(max(2.0, tokens))), 60.0]
    for _ in range(rounds):
        if not bracket:
            break
        now = spark.createDataFrame([(s, out[s], totals[s][0] / totals[s][1], float(caps[s])) for s in bracket], "source string, l double, mean double, cap double")
        z = F.col("tokens") / F.col("mean")
        # beyond the cap the rate is constant; exponents are bounded so that nothing overflows
        power = F.greatest(F.lit(-700.0), F.least(F.col("l") * z, F.log("cap") + 1))
        rate = F.least(F.col("cap"), F.exp(power))
        slope = F.when(rate < F.col("cap"), rate * z).otherwise(0.0)
        w = F.col("n") * F.col("tokens")
        sums = histogram.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(w * rate).alias("g"), F.sum(w * slope).alias("h")).collect()
        for s, g, h in sums:
            low, high = bracket[s]
            if abs(g - goals[s]) <= close * max(1.0, goals[s]):
                del bracket[s]
                continue
            low, high = (out[s], high) if g < goals[s] else (low, out[s])
            bracket[s] = [low, high]
            if high - low < 1e-13 * max(1.0, abs(low), abs(high)):
                del bracket[s]
                continue
            # Newton on the logarithm of the tokens, which is nearly straight
            step = out[s] + (math.log(goals[s]) - math.log(g)) * g / h if g > 0 and h > 0 else math.nan
            out[s] = step if low < step < high else (low + high) / 2
    return out


def mix(sized: DataFrame, key: str, size: str, source: str, targets: list[tuple[str, float, int]], total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with copies >= 1, shares reached by source).

    targets: (source, target share, most copies of a document). The mixture is as large as the shares
    allow: the source that runs out first at its cap bounds it, unless `total` tokens are asked for.
    Rates come from `solve`; they are rounded to whole copies by a hash of the document, with a
    threshold per source that is found from a histogram and settled document by document in its last
    step, so that each source ends within one document of its goal.

    Defined cases: documents of other sources, with a null key or without tokens are not used; a target
    source without tokens can't contribute: its share stays 0 and the others keep their proportions;
    shares are scaled to sum to 1; repeated rows are separate documents; no target or no document gives
    an empty mixture. Other columns are ignored.
    """
    spark = sized.sparkSession
    if len(targets) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    space = Workspace(spark, "mixing")
    wanted = spark.createDataFrame([(s, float(w), int(m)) for s, w, m in targets if w > 0 and m > 0], "source string, target_share double, cap int")
    used = space.keep(sized.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(size).cast("bigint").alias("tokens")).filter("key IS NOT NULL AND tokens > 0").join(F.broadcast(wanted.select("source", "cap")), "source"))
    histogram = space.keep(used.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    totals = {r[0]: (float(r[1]), float(r[2])) for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")), F.sum("n")).collect()}
    present = [(s, w, m) for s, w, m in targets if s in totals and w > 0 and m > 0]
    whole = sum(w for _, w, _ in present)
    caps = {s: m for s, _, m in present}
    most = min((m * totals[s][0] * whole / w for s, w, m in present), default=0.0)
    size_all = min(most, total) if total else most
    goals = {s: size_all * w / whole for s, w, _ in present}
    tilt = solve(histogram, totals, goals, caps)
    plan = spark.createDataFrame([(s, tilt[s], totals[s][0] / totals[s][1], goals[s]) for s in goals], "source string, l double, mean double, goal double")
    cap = F.col("cap").cast("double")
    power = F.greatest(F.lit(-700.0), F.least(F.col("l") * F.col("tokens") / F.col("mean"), F.log(cap) + 1))
    rated = used.join(F.broadcast(plan), "source").withColumn("rate", F.when(F.col("l") == F.lit(math.inf), cap).otherwise(F.least(cap, F.exp(power))))
    unit = F.xxhash64(F.lit("mix"), "key", "source") / F.lit(2.0**64) + 0.5
    lot = F.when(F.floor("rate") < F.col("cap"), unit - (F.col("rate") - F.floor("rate")))
    drawn = space.keep(rated.select("key", "source", "tokens", "cap", "goal", "rate", F.floor("rate").cast("int").alias("floor"), lot.alias("lot")).withColumn("step", F.floor((F.col("lot") + 1) * F.lit(STEPS / 2)).cast("int")))
    steps = drawn.filter("lot IS NOT NULL").groupBy("source", "step").agg(F.sum("tokens").alias("gain"))
    sure = drawn.groupBy("source").agg(F.first("goal").alias("goal"), F.sum(F.col("floor") * F.col("tokens")).alias("sure"))
    upto = Window.partitionBy("source").orderBy("step")
    # at most STEPS rows a source, however many documents it has
    lines = steps.join(F.broadcast(sure), "source").withColumn("before", F.sum("gain").over(upto) - F.col("gain"))
    last = lines.filter(F.col("sure") + F.col("before") <= F.col("goal")).groupBy("source").agg(F.max("step").alias("edge"), F.max_by(F.col("goal") - F.col("sure") - F.col("before"), "step").alias("open"))
    last = space.keep(last)
    # the edge step of each source is divided once more, so that what is settled document by document is 1 / STEPS squared of it
    fine = F.floor(F.pmod((F.col("lot") + 1) * F.lit(STEPS / 2), F.lit(1.0)) * STEPS).cast("int")
    placed = drawn.join(F.broadcast(last), "source", "left").withColumn("fine", F.when(F.col("step") == F.col("edge"), fine))
    parts = placed.filter("fine IS NOT NULL").groupBy("source", "fine").agg(F.sum("tokens").alias("gain"), F.first("open").alias("open"))
    finer = parts.withColumn("before", F.sum("gain").over(Window.partitionBy("source").orderBy("fine")) - F.col("gain"))
    close = space.keep(finer.filter(F.col("before") <= F.col("open")).groupBy("source").agg(F.max("fine").alias("brink"), F.max_by(F.col("open") - F.col("before"), "fine").alias("rest")))
    placed = placed.join(F.broadcast(close), "source", "left")
    inside = placed.filter(F.col("fine") == F.col("brink")).withColumn("sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("lot", "key")))
    inside = inside.withColumn("extra", (F.col("sum") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    within = (F.col("step") < F.col("edge")) | ((F.col("step") == F.col("edge")) & (F.col("fine") < F.col("brink")))
    outside = placed.filter(~F.coalesce(F.col("fine") == F.col("brink"), F.lit(False))).withColumn("extra", F.coalesce(within.cast("int"), F.lit(0)))
    columns = ["key", "source", "tokens", "rate", (F.col("floor") + F.col("extra")).alias("copies")]
    chosen = space.keep(inside.select(*columns).unionByName(outside.select(*columns)).filter("copies > 0"))
    reached = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    grand = chosen.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0
    shares = wanted.select("source", "target_share", F.col("cap").alias("max_repeats")).join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(grand, 1)))).alias("reached_share"),
    )
    return chosen.withColumnRenamed("key", key), shares
