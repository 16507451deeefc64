"""One group identifier for all records that are linked directly or indirectly.

Two algorithms over an edge table (u, v): Borůvka hooking with pointer doubling, and alternating
large-star and small-star. Both keep every table distributed, write each round into the shared folder,
and need a number of rounds that is logarithmic in the size of the largest group, however long a chain is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import Workspace, small


def _clean(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected links once each, without nulls and self links; u < v."""
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct()


def boruvka(pairs: DataFrame, a: str, b: str, name: str = "boruvka") -> DataFrame:
    """(member, root) for every endpoint of `pairs`; root is the smallest member of its group.

    Each round, every component selects its smallest outgoing edge (edges are ordered by their two
    labels, so the selected edges form trees with one two-cycle each, which the smaller label of the
    two breaks), trees collapse by pointer doubling, and edges are relabelled and deduplicated, until
    none remain. A component with very many edges is aggregated before it is shuffled, and its parent
    row is the small side of the relabelling join, so a hot component splits like any skewed key.

    Defined cases: rows with a null end link nothing and name no member; self links name a member but
    link nothing; repeated and reversed links count once; an empty input gives an empty table. Ends may
    be of any orderable type. Other columns are ignored.
    """
    spark = pairs.sparkSession
    space = Workspace(spark, name)
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    base = space.keep(ends.distinct())
    edges, seen = space.keep(_clean(base, "u", "v"), F.count(F.lit(1)).alias("n"))
    labels: DataFrame | None = None
    while seen["n"]:
        ways = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest outgoing edge in the order of (smaller label, greater label) leads to the smallest neighbour
        chosen = ways.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("p"))
        parents = space.keep(chosen)
        # c and p chose each other: the smaller one becomes the root
        hooked = parents.join(small(parents).select(F.col("c").alias("p"), F.col("p").alias("gp")), "p", "left")
        hooked = hooked.select("c", F.when((F.col("gp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        tree = space.keep(hooked)
        space.drop(parents)
        while True:
            jump = small(tree).select(F.col("c").alias("p"), F.col("p").alias("q"))
            twice = tree.join(jump, "p").select("c", "p", "q")
            hop = small(tree).select(F.col("c").alias("q"), F.col("p").alias("r"))
            moved = twice.join(hop, "q").select("c", F.col("r").alias("p"), (F.col("r") != F.col("p")).alias("moved"))
            after, counted = space.keep(moved.select("c", "p", "moved"), F.coalesce(F.sum(F.col("moved").cast("bigint")), F.lit(0)).alias("moved"))
            space.drop(tree)
            tree = after
            if not counted["moved"]:
                break
        tree_view = small(tree).select(F.col("c"), F.col("p"))
        if labels is None:
            relabelled = space.keep(tree.select(F.col("c").alias("member"), F.col("p").alias("root")))
        else:
            step = labels.join(tree_view.withColumnsRenamed({"c": "root", "p": "next"}), "root", "left")
            relabelled = space.keep(step.select("member", F.coalesce("next", "root").alias("root")))
            space.drop(labels)
        labels = relabelled
        left = edges.join(tree_view.withColumnsRenamed({"c": "u", "p": "pu"}), "u").join(tree_view.withColumnsRenamed({"c": "v", "p": "pv"}), "v")
        after, seen = space.keep(_clean(left, "pu", "pv"), F.count(F.lit(1)).alias("n"))
        space.drop(edges, tree)
        edges = after
    alone = base.select(F.explode(F.array("u", "v")).alias("member")).distinct()
    if labels is None:
        return alone.select("member", F.col("member").alias("root"))
    smallest = labels.groupBy("root").agg(F.min("member").alias("least"))
    # a root is one label per group: the table of roots is as small as the number of groups, not of members
    named = labels.join(smallest, "root").select("member", F.col("least").alias("root"))
    return alone.join(named, "member", "left").select("member", F.coalesce("root", "member").alias("root"))


def stars(pairs: DataFrame, a: str, b: str, name: str = "stars") -> DataFrame:
    """(member, root) for every endpoint of `pairs`, by alternating large-star and small-star.

    Large-star links the greater neighbours of a node to its smallest neighbour, small-star the smaller
    ones and itself; when neither changes the edges, each group is a star around its smallest member.
    The smallest neighbour of a node is a partial aggregate and the edges of a hot node are the only
    skewed side of its join, so adaptive execution can split them.

    Defined cases: as for `boruvka`.
    """
    spark = pairs.sparkSession
    space = Workspace(spark, name)
    ends = space.keep(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct())
    nodes = space.keep(ends.select(F.explode(F.array("u", "v")).alias("member")).distinct())
    check = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")]
    edges, seen = space.keep(_clean(ends, "u", "v"), *check)

    def linked(ways: DataFrame, keep: Column) -> DataFrame:
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = ways.join(least, "u")
        return joined.filter(keep).select(F.col("m").alias("u"), "v").filter("u < v")

    state = (seen["n"], seen["h"])
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = space.keep(linked(both, F.col("v") > F.col("u")).distinct())
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select(F.col("m").alias("u"), F.col("u").alias("v"))
        rest = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("m").alias("u"), "v")
        after, seen = space.keep(own.unionAll(rest).filter("u < v").distinct(), *check)
        space.drop(edges, large)
        edges = after
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    roots = edges.select(F.col("v").alias("member"), F.col("u").alias("root"))
    return nodes.join(roots, "member", "left").select("member", F.coalesce("root", "member").alias("root"))
