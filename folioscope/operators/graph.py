"""Networks of characters: one graph per work, as node and edge tables keyed by graph_id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import Workspace

# fixed values: verbs of each kind of event ('executed' counts in two)
MACRO = {
    "violence": ["killed", "murdered", "died", "executed", "fought", "dueled", "attacked", "poisoned", "wounded", "assassinated", "stabbed"],
    "courtship": ["married", "courted", "proposed", "rejected", "confessed love", "fell in love", "declared love", "engaged", "attracted_to"],
    "movement": ["arrived", "departed", "traveled", "fled", "returned", "escaped", "shipwrecked", "embarked", "landed", "visited"],
    "deception": ["deceived", "disguised", "betrayed", "plotted", "conspired", "forged", "impersonated", "feigned"],
    "legal": ["arrested", "imprisoned", "tried", "convicted", "sentenced", "pardoned", "acquitted", "confessed", "accused", "executed"],
}


def _known(links: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links whose two ends are nodes of their graph."""
    ids = nodes.select("graph_id", "id").distinct()
    for end in (a, b):
        links = links.join(ids.withColumnRenamed("id", end), ["graph_id", end], "left_semi")
    return links


def _chosen(relations: DataFrame, only: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    out = relations.filter(~F.col("type").isin(list(exclude or ("same_as",))))
    return out.filter(F.col("type").isin(list(only))) if only else out


def undirected(relations: DataFrame, nodes: DataFrame, only: Sequence[str] = (), exclude: Sequence[str] = ("same_as",)) -> DataFrame:
    """(graph_id, a, b, weight, type, types): one edge per pair, a <= b; type is the first one by `ord`. An empty exclusion still leaves same_as out."""
    r = _known(_chosen(relations, only, exclude), nodes)
    return r.groupBy("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("weight"), F.min_by("type", "ord").alias("type"), F.array_sort(F.collect_list("type")).alias("types"))


def directed(relations: DataFrame, nodes: DataFrame, only: Sequence[str] = (), exclude: Sequence[str] = ("same_as",)) -> DataFrame:
    """(graph_id, a, b, weight, type, types): one edge per ordered pair."""
    r = _known(_chosen(relations, only, exclude), nodes)
    return r.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("weight"), F.min_by("type", "ord").alias("type"), F.array_sort(F.collect_list("type")).alias("types"))


def interactions(rows: DataFrame, nodes: DataFrame, a: str, b: str, payload: str) -> DataFrame:
    """Directed edges of dialogue (speaker, addressee, gist) or events (who, whom, verb) with what happened in order."""
    r = _known(rows.select("graph_id", F.col(a).alias("a"), F.col(b).alias("b"), F.col(payload).alias("p"), "ord").filter("a <> '' AND b <> ''"), nodes)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "p"))), lambda x: x["p"])
    return r.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("weight"), listed.alias("payload"))


def composite(relations: DataFrame, events: DataFrame, dialogue: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, a, b, weight, rel_types, event_verbs, n_dialogue) over relations (a, b, type), events (who, whom, what) and dialogue (speaker, addressee)."""
    parts = [
        relations.filter("type <> 'same_as'").select("graph_id", "a", "b", F.lit("r").alias("k"), F.col("type").alias("v"), "ord"),
        events.select("graph_id", F.col("who").alias("a"), F.col("whom").alias("b"), F.lit("e").alias("k"), F.col("what").alias("v"), "ord"),
        dialogue.select("graph_id", F.col("speaker").alias("a"), F.col("addressee").alias("b"), F.lit("d").alias("k"), F.lit(None).cast("string").alias("v"), "ord"),
    ]
    every = _known(parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("a <> '' AND b <> ''"), nodes)
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when((F.col("k") == k) & F.col("v").isNotNull(), F.struct("ord", "v")))), lambda x: x["v"])
    return every.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("weight"), of("r").alias("rel_types"), of("e").alias("event_verbs"), F.count_if(F.col("k") == "d").alias("n_dialogue"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, id, degree) for every node; a loop counts twice."""
    ends = edges.select("graph_id", F.explode(F.array("a", "b")).alias("id")).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("graph_id", "id").distinct().join(ends, ["graph_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def active(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with an edge."""
    return nodes.join(edges.select("graph_id", F.explode(F.array("a", "b")).alias("id")).distinct(), ["graph_id", "id"], "left_semi")


def simple(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, without loops."""
    return edges.select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, id, triangles): triangles at each node.

    Edges point to the end of higher degree, so a hub starts few paths and the paths of two edges stay
    within the square root of the number of edges per edge, however skewed the degrees are.
    """
    e = simple(edges)
    d = e.select("graph_id", F.explode(F.array("a", "b")).alias("id")).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("k"))
    both = e.join(d.withColumnsRenamed({"id": "a", "k": "ka"}), ["graph_id", "a"]).join(d.withColumnsRenamed({"id": "b", "k": "kb"}), ["graph_id", "b"])
    low = F.struct("ka", "a") <= F.struct(F.col("kb").alias("ka"), F.col("b").alias("a"))
    up = both.select("graph_id", F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    paths = up.join(up.withColumnRenamed("y", "z"), ["graph_id", "x"]).filter("y < z")
    closed = paths.join(e.withColumnsRenamed({"a": "y", "b": "z"}), ["graph_id", "y", "z"], "left_semi")
    return closed.select("graph_id", F.explode(F.array("x", "y", "z")).alias("id")).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, clustering, transitivity): mean local clustering over all nodes, and closed over all paths of two edges."""
    k = degrees(simple(edges), nodes)
    t = k.join(triangles(edges), ["graph_id", "id"], "left").withColumn("t", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    local = F.when(F.col("degree") > 1, F.col("t") / F.nullif(pairs, F.lit(0.0))).otherwise(0.0)
    return t.groupBy("graph_id").agg(F.avg(local).alias("clustering"), F.coalesce(F.sum("t") / F.nullif(F.sum(pairs), F.lit(0.0)), F.lit(0.0)).alias("transitivity"))


def basics(edges: DataFrame, nodes: DataFrame, is_directed: bool = False, mutual: bool = True) -> DataFrame:
    """(graph_id, n_nodes, n_edges, density, mean_degree, max_degree, max_degree_node, reciprocity); ties of the degree go to the smaller id. Without `mutual` reciprocity is null."""
    k = degrees(edges, nodes)
    per = k.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("max_degree_node"))
    counted = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = per.join(counted, "graph_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    room = F.col("n_nodes") * (F.col("n_nodes") - 1)
    out = out.withColumn("density", F.coalesce((1 if is_directed else 2) * F.col("n_edges") / F.nullif(room, F.lit(0)), F.lit(0.0)))
    if not (is_directed and mutual):
        return out.withColumn("reciprocity", F.lit(None).cast("double"))
    d = edges.select("graph_id", "a", "b").distinct()
    back = d.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))
    both = d.filter("a <> b").join(back, ["graph_id", "a", "b"], "left_semi").groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    return out.join(both, "graph_id", "left").withColumn("reciprocity", F.coalesce(F.coalesce("m", F.lit(0)) / F.nullif("n_edges", F.lit(0)), F.lit(0.0))).drop("m")


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked with, over links x-y."""
    root = np.arange(n)
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(far := root[root], root):
            root = far


def _peel(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Takes ends of paths off the links x-y until none is left: (alive, weight, squares, height, across).

    Of each node: whether it is left; itself and the nodes taken off behind it; the sum of the squared weights
    of those taken off at it; the longest way down to them; the longest way between two of them through it.
    """
    degree = np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
    near = np.zeros(n, np.int64)  # of a node with one link: its neighbour
    np.bitwise_xor.at(near, x, y)
    np.bitwise_xor.at(near, y, x)
    alive, weight, squares = np.ones(n, bool), np.ones(n, np.int64), np.zeros(n, np.int64)
    height, across = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves, depth = np.flatnonzero(degree == 1), 0
    while len(leaves):
        depth += 1
        up = near[leaves]
        off = (degree[up] > 1) | (leaves > up)  # of two nodes that have only each other the first stays
        leaves, up = leaves[off], up[off]
        alive[leaves], degree[leaves] = False, 0
        np.add.at(weight, up, weight[leaves])
        np.add.at(squares, up, weight[leaves] ** 2)
        np.bitwise_xor.at(near, up, leaves)
        at, many = np.unique(up, return_counts=True)
        degree[at] -= many
        across[at] = np.maximum(across[at], depth + np.where(many > 1, depth, height[at]))
        height[at] = depth  # all that go off in one round are equally high
        leaves = at[degree[at] == 1]
    return alive, weight, squares, height, across


def _between(start: np.ndarray, room: np.ndarray, ptr: np.ndarray, ends: np.ndarray, weight: np.ndarray, height: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the paths from `sources`: what they add to the betweenness of each node; and of each source the farthest pair of nodes behind it and behind another node, and the sum of distances.

    Nodes of one component stand side by side from `start` on, `room` of them; the neighbours of v are
    ends[ptr[v]:ptr[v + 1]]; a node stands for `weight` nodes, the farthest of them `height` behind it. A
    batch of sources goes on step by step together, so that a step is a few operations on arrays.
    """
    between, far, total = np.zeros(len(room)), np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    slots = np.concatenate(([0], np.cumsum(room[sources])))
    low = 0
    while low < len(sources):
        high = max(low + 1, int(np.searchsorted(slots, slots[low] + SLOTS, "right")) - 1)
        s = sources[low:high]
        # the place of node v in the tables of source k is shift[k] + v
        shift = slots[low:high] - slots[low] - start[s]
        seen, mark = np.zeros(slots[high] - slots[low], bool), np.empty(slots[high] - slots[low], np.int64)
        k, v, sigma = np.arange(len(s)), s, np.ones(len(s))
        seen[shift + s] = True
        levels, steps = [], []
        while len(v):
            levels.append((k, v, sigma))
            count = ptr[v + 1] - ptr[v]
            parent = np.repeat(np.arange(len(v)), count)
            w = ends[np.arange(len(parent)) + np.repeat(ptr[v] - np.cumsum(count) + count, count)]
            slot = shift[k[parent]] + w
            new = np.flatnonzero(~seen[slot])
            slot, parent = slot[new], parent[new]
            order = np.arange(len(slot))
            mark[slot] = order
            first = np.flatnonzero(mark[slot] == order)
            mark[slot[first]] = np.arange(len(first))
            child = mark[slot]
            seen[slot[first]] = True
            k, v, sigma = k[parent[first]], w[new[first]], np.bincount(child, sigma[parent], len(first))
            steps.append((parent, child))
            d = len(levels)
            np.maximum.at(far, low + k, d + height[v] + height[s[k]])
            total[low:high] += d * np.bincount(k, weight[v], len(s)).astype(np.int64)
        total[low:high] *= weight[s]
        delta = np.zeros(0)
        for (k, v, sigma), (parent, child) in zip(reversed(levels), reversed(steps)):
            delta = sigma * np.bincount(parent, delta[child], len(v)) if len(child) else np.zeros(len(v))
            if v is not s:
                np.add.at(between, v, delta * weight[s[k]])
                delta = (weight[v] + delta) / sigma
        low = high
    return between, far, total


#: Sources of shortest paths that one task takes on; a larger graph is dealt to several.
SOURCES = 2048
#: Nodes of small graphs that share a task, on average.
BUCKET = 2_000
#: Places of the tables of a batch of sources.
SLOTS = 1 << 19


def _measured(n: int, x: np.ndarray, y: np.ndarray, block: np.ndarray, blocks: np.ndarray, unit: np.ndarray, ways: bool) -> tuple[np.ndarray, ...]:
    """(kept, share, root, size, reach, total) of n nodes with links x-y; with `ways` also over shortest paths, from every source of the node's block."""
    root = _roots(n, x, y)
    size = np.bincount(root, minlength=n)[root]
    kept, share, reach, total = block == 0, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not ways:
        return kept, share, root, size, reach, total
    alive, weight, squares, height, across = _peel(n, x, y)
    # paths that end behind the node itself; block 0 counts them
    inside, rest = weight - 1, size - weight
    share[:] = np.where(alive, inside**2 - squares + 2 * inside * rest, (size - 1) ** 2 - squares - rest**2) * kept
    total[:] = np.where(alive, 0, 2 * weight * rest) * kept
    reach[:] = across * kept
    both = alive[x] & alive[y]
    x, y = x[both], y[both]
    core = np.unique(np.concatenate((x, y)))
    if len(core):
        core = core[np.argsort(root[core], kind="stable")]
        place = np.empty(n, np.int64)
        place[core] = np.arange(len(core))
        a, b = place[np.concatenate((x, y))], place[np.concatenate((y, x))]
        ends = b[np.argsort(a, kind="stable")]
        ptr = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=len(core)))))
        _, start, member, room = np.unique(root[core], return_index=True, return_inverse=True, return_counts=True)
        # the sources of a graph are dealt in turn to its blocks
        turn = np.argsort(unit[core], kind="stable")
        u = unit[core][turn]
        rank = np.empty(len(core), np.int64)
        rank[turn] = np.arange(len(core)) - np.searchsorted(u, u)
        mine = np.flatnonzero(rank % blocks[core] == block[core])
        between, far, sums = _between(start[member], room[member], ptr, ends, weight[core], height[core], mine)
        share[core] += between
        reach[core[mine]] = np.maximum(reach[core[mine]], far)
        total[core[mine]] += sums
        kept = kept | (share > 0)
        kept[core[mine]] = True
    return kept, share, root, size, reach, total


def _pieces(edges: DataFrame, nodes: DataFrame, ways: bool) -> DataFrame:
    """(graph_id, id, share, component, size, reach, total) of every node: unscaled betweenness, first node and size of its component; the greatest reach and the sum of total over a component are its diameter and its sum of distances."""
    ids = nodes.select("graph_id", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).distinct()
    links = simple(edges).select("graph_id", "a", "b")
    if ways:
        n = ids.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).join(links.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m")), "graph_id")
        blocks = n.select("graph_id", F.ceil(F.least("n", "m") / SOURCES).cast("int").alias("blocks"))
        rows = ids.unionByName(links).join(blocks, "graph_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        rows = ids.unionByName(links).withColumns({"blocks": F.lit(1), "block": F.lit(0)})
    kind = nodes.schema["graph_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node = frame["b"].isna().to_numpy()
        g, graphs = pd.factorize(frame["graph_id"], use_na_sentinel=False)
        unit, _ = pd.factorize(g * np.int64(frame["blocks"].max()) + frame["block"].to_numpy())
        codes, names = pd.factorize(pd.concat([frame["a"], frame.loc[~node, "b"]], ignore_index=True), sort=True)
        width = len(names) + 1
        key, other = unit * width + codes[: len(frame)], unit[~node] * width + codes[len(frame) :]
        place, at = np.unique(key[node], return_index=True)
        at = np.flatnonzero(node)[at]
        x, y = np.searchsorted(place, key[~node]), np.searchsorted(place, other)
        top = len(place) - 1
        known = (place[np.minimum(x, top)] == key[~node]) & (place[np.minimum(y, top)] == other) if top >= 0 else np.zeros(len(x), bool)
        block, blocks = frame["block"].to_numpy()[at].astype(np.int64), frame["blocks"].to_numpy()[at].astype(np.int64)
        kept, share, root, size, reach, total = _measured(len(place), x[known], y[known], block, blocks, unit[at], ways)
        kept = np.flatnonzero(kept)
        label = codes[at]
        return pd.DataFrame({"graph_id": np.asarray(graphs, dtype=object)[g[at][kept]], "id": names[label[kept]], "share": share[kept], "component": names[label[root[kept]]], "size": size[kept], "reach": reach[kept], "total": total[kept]})

    # small graphs share a task; what a task gets is bounded by the number of nodes in all
    buckets = int(max(1, -(-(ids.count()) // BUCKET)))
    placed = rows.withColumn("bucket", F.when(F.col("blocks") > 1, F.xxhash64("graph_id", "block")).otherwise(F.pmod(F.xxhash64("graph_id"), F.lit(buckets))))
    parts = placed.groupBy("bucket").applyInPandas(run, f"graph_id {kind}, id string, share double, component string, size bigint, reach bigint, total bigint")
    if not ways:
        return parts
    return parts.groupBy("graph_id", "id").agg(F.sum("share").alias("share"), F.max("component").alias("component"), F.max("size").alias("size"), F.max("reach").alias("reach"), F.sum("total").alias("total"))


def parts_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, components, largest): the number of components of each graph and the nodes of the largest."""
    first = F.col("component") == F.col("id")
    return _pieces(edges, nodes, False).groupBy("graph_id").agg(F.count_if(first).cast("int").alias("components"), F.max("size").cast("int").alias("largest"))


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, id, betweenness, component, n_components, largest, diameter, mean_path): all that needs shortest paths.

    Trees are taken off first: what paths to and from them add follows from the sizes of their parts, so only
    the rest, each node with the weight of what hung on it, needs paths. Paths from different sources are
    independent: each graph is dealt to as many tasks as it has blocks of SOURCES nodes, each of which gets
    the graph's edges and adds up its own sources' share, so a work with a very large cast doesn't wait
    for one task. diameter and mean_path are those of the largest component.
    """
    per = _pieces(edges, nodes, True)
    every = Window.partitionBy("graph_id")
    n = F.count(F.lit(1)).over(every)
    best = F.min(F.struct(-F.col("size"), F.col("component"))).over(every)
    first = (F.col("component") == F.col("id")).cast("int")
    per = per.withColumns({"n": n, "best": best["component"], "n_components": F.sum(first).over(every).cast("int"), "largest": F.max("size").over(every).cast("int")})
    inside = F.col("component") == F.col("best")
    room = (F.col("n") - 1) * (F.col("n") - 2)
    mean = F.sum(F.when(inside, F.col("total"))).over(every) / F.nullif(F.col("largest").cast("bigint") * (F.col("largest") - 1), F.lit(0))
    return per.select(
        "graph_id", "id", F.when(F.col("n") > 2, F.col("share") / F.nullif(room, F.lit(0))).otherwise(F.col("share")).alias("betweenness"), "component", "n_components", "largest",
        F.max(F.when(inside, F.col("reach"))).over(every).cast("int").alias("diameter"), F.coalesce(mean, F.lit(0.0)).alias("mean_path"),
    )


#: What of a profile needs shortest paths, and what their components alone.
PATHS, COMPONENTS = {"max_betweenness", "mean_betweenness", "centralization", "diameter", "avg_path"}, {"components", "largest_cc_frac"}


def profile(edges: DataFrame, nodes: DataFrame, is_directed: bool = False, measures: Sequence[str] = ()) -> DataFrame:
    """One row per graph with all measures, or with those named; diameter and mean path only where the whole graph is connected.

    Only what the measures need is worked out: components come from the links alone, without shortest paths.
    """
    from folioscope.operators.stats import gini

    need = lambda *names: not measures or bool(set(names) & set(measures))
    space = Workspace(edges.sparkSession, "profile")
    edges, nodes = space.keep(edges.select("graph_id", "a", "b")), space.keep(nodes.select("graph_id", "id").distinct())
    out = basics(edges, nodes, is_directed, need("reciprocity"))
    if need(*PATHS):
        p = paths(edges, nodes)
        out = out.join(p.groupBy("graph_id").agg(F.max("betweenness").alias("max_betweenness"), F.avg("betweenness").alias("mean_betweenness"), F.first("n_components").alias("components"), F.first("largest").alias("largest"), F.first("diameter").alias("diameter"), F.first("mean_path").alias("mean_path")), "graph_id")
    elif need(*COMPONENTS):
        out = out.join(parts_of(edges, nodes), "graph_id")
    k = degrees(simple(edges), nodes)
    if need("clustering", "transitivity"):
        out = out.join(clustering(edges, nodes), "graph_id")
    if need("degree_gini"):
        out = out.join(gini(k, ["graph_id"], "degree").withColumnRenamed("gini", "degree_gini"), "graph_id")
    if need("assortativity"):
        ends = simple(edges).select("graph_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("graph_id", "e.x", "e.y")
        kx = k.select("graph_id", F.col("id").alias("x"), F.col("degree").cast("double").alias("kx"))
        mixed = ends.join(kx, ["graph_id", "x"]).join(kx.withColumnsRenamed({"x": "y", "kx": "ky"}), ["graph_id", "y"]).groupBy("graph_id").agg(F.covar_pop("kx", "ky").alias("c"), (F.stddev_pop("kx") * F.stddev_pop("ky")).alias("v"))
        out = out.join(mixed.select("graph_id", F.when(F.col("v") > 1e-12, F.col("c") / F.nullif("v", F.lit(0.0))).alias("assortativity")), "graph_id", "left")
    if need("max_degree_cent"):
        out = out.join(k.groupBy("graph_id").agg((F.max("degree") / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("max_degree_cent")), "graph_id")
    one = (F.col("components") == 1) & (F.col("n_nodes") > 1)
    r = lambda c, n=4: F.round(c, n)
    columns = {
        "n_nodes": F.col("n_nodes"), "n_edges": F.col("n_edges"), "density": r("density"), "reciprocity": r("reciprocity"), "components": F.col("components"), "largest_cc_frac": r(F.col("largest") / F.col("n_nodes")),
        "clustering": F.when(F.col("n_nodes") >= 3, r("clustering")), "transitivity": F.when(F.col("n_nodes") >= 3, r("transitivity")), "max_betweenness": r("max_betweenness"), "mean_betweenness": r("mean_betweenness"),
        "centralization": r(F.col("max_betweenness") - F.col("mean_betweenness")), "max_degree_cent": r("max_degree_cent"), "degree_gini": r("degree_gini"), "assortativity": r("assortativity"),
        "diameter": F.when(one, F.col("diameter")), "avg_path": F.when(one, r("mean_path", 2)),
    }
    return out.select("graph_id", *[columns[m].alias(m) for m in measures or columns])


def counts(rows: DataFrame, value: str, exclude: Sequence[str] = ()) -> DataFrame:
    """How often each relation type or verb occurs in each graph."""
    kept = rows.filter(~F.col(value).isin(list(exclude))) if exclude else rows
    return kept.filter(F.col(value).isNotNull()).groupBy("graph_id", value).agg(F.count(F.lit(1)).alias("n"))


def macro_counts(events: DataFrame, verb: str, macro: Mapping[str, Sequence[str]] = MACRO) -> DataFrame:
    """One column per kind of event; a verb may belong to several kinds."""
    v = F.lower(verb)
    return events.groupBy("graph_id").agg(*[F.count_if(v.isin(list(vs))).alias(k) for k, vs in macro.items()])


def passage_number(passage):
    """P042 -> 42, so that order is by number; null stays null."""
    return F.regexp_extract(passage, r"(\d+)", 1).try_cast("int")


def locations(events: DataFrame) -> DataFrame:
    """(graph_id, location, n_events, n_characters, characters, first_passage, last_passage) of events (who, where, passage)."""
    e = events.filter("`where` <> ''")
    return e.groupBy("graph_id", F.col("where").alias("location")).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("who").alias("n_characters"), F.array_sort(F.collect_set("who")).alias("characters"), F.min(passage_number(F.col("passage"))).alias("first_passage"), F.max(passage_number(F.col("passage"))).alias("last_passage"))


def trajectories(events: DataFrame) -> DataFrame:
    """(graph_id, who, steps): places of each character in the order of passages."""
    e = events.filter("`where` <> '' AND who <> ''")
    step = F.struct(passage_number(F.col("passage")).alias("passage"), F.col("ord"), F.col("where"), F.col("what"))
    return e.groupBy("graph_id", "who").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: F.concat_ws("/", x["passage"].cast("string"), x["where"], x["what"])).alias("steps"))


def top_label(edges: DataFrame, payload: str) -> DataFrame:
    """The most frequent label of each edge, ties by label."""
    n = edges.select("graph_id", "a", "b", F.explode(payload).alias("label")).groupBy("graph_id", "a", "b", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("graph_id", "a", "b").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("n"))


def top_characters(scores: DataFrame, score: str, top: int) -> DataFrame:
    """The `top` nodes of each graph by a score, ties by id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc(score), "id"))).filter(F.col("rank") <= top)


def merge_register(members: DataFrame) -> DataFrame:
    """(graph_id, root, name, aliases, first_seen, last_seen, notes) from (graph_id, root, id, name, seen, notes): merged characters under the smallest id."""
    listed = F.array_sort(F.collect_list(F.struct("id", "name", "notes")))
    g = members.groupBy("graph_id", "root").agg(listed.alias("m"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return g.select("graph_id", "root", F.col("m")[0]["name"].alias("name"), F.transform(F.slice("m", F.lit(2), F.size("m")), lambda x: x["name"]).alias("aliases"), "first_seen", "last_seen", F.concat_ws("; ", F.filter(F.transform("m", lambda x: x["notes"]), lambda x: x.isNotNull() & (x != ""))).alias("notes"))


def components(links: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(graph_id, id, root) for every node: root is the smallest id that it is linked with, directly or indirectly, within its graph.

    Every round each node takes the smallest root among its neighbours and then the root of that root, so
    the rounds grow with the logarithm of a chain. Nodes and links stay distributed whatever the size of a
    graph; each round is written, so lost executors cost no more than a round.

    Defined cases: links with a null end or an end that is no node of the graph link nothing; repeated,
    reversed and self links change nothing; an empty table gives an empty one.
    """
    space = Workspace(links.sparkSession, "components")
    labels = space.keep(nodes.select("graph_id", "id").distinct().withColumn("root", F.col("id")))
    ends = _known(links.select("graph_id", F.col(a).alias("a"), F.col(b).alias("b")), nodes).filter("a <> b").select("graph_id", "a", "b")
    ways = space.keep(ends.unionByName(ends.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        # also the root of a node hears of the smaller root, so whole trees move at once
        near = ways.join(labels.select("graph_id", F.col("id").alias("b"), "root"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("id")).agg(F.min("root").alias("near"))
        own = labels.join(near, ["graph_id", "id"], "left").withColumn("new", F.least("root", "near"))
        offers = space.keep(own.select("graph_id", "id", "root", F.coalesce("new", "root").alias("new")))
        told = offers.filter("new < root").groupBy("graph_id", F.col("root").alias("id")).agg(F.min("new").alias("told"))
        step = space.keep(offers.join(told, ["graph_id", "id"], "left").select("graph_id", "id", "root", F.least("new", F.coalesce("told", "new")).alias("new")))
        jump = step.select("graph_id", F.col("id").alias("new"), F.col("new").alias("far"))
        after, seen = space.keep(step.join(jump, ["graph_id", "new"]).select("graph_id", "id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), F.coalesce(F.sum(F.col("moved").cast("bigint")), F.lit(0)).alias("moved"))
        space.drop(labels, offers, step)
        labels = after.drop("moved")
        labels._workspace_path = after._workspace_path
        if not seen["moved"]:
            return labels


def register(characters: DataFrame, relations: DataFrame) -> DataFrame:
    """Characters (graph_id, id, name, seen, notes) merged by the same_as relations among them, under the smallest id (see `merge_register`)."""
    roots = components(relations.filter("type = 'same_as'"), characters)
    return merge_register(characters.join(roots, ["graph_id", "id"]))


def profiles(networks: Mapping[str, tuple[DataFrame, bool]], nodes: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per graph with the measures of several networks over the same nodes, each under its prefix (e.g. `dialogue_density`).

    The networks of one direction are profiled as one table of graphs, so their number adds rows and no passes.
    """
    parts = []
    for way in sorted({d for _, d in networks.values()}):
        edges = members = None
        for name, (network, is_directed) in networks.items():
            if is_directed != way:
                continue
            tag = F.concat(F.lit(name + "\x01"), F.col("graph_id").cast("string")).alias("graph_id")
            e, n = network.select(tag, "a", "b"), nodes.select(tag, "id")
            edges, members = (e, n) if edges is None else (edges.unionByName(e), members.unionByName(n))
        parts.append(profile(edges, members, way, measures))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    split = whole.withColumns({"_net": F.substring_index("graph_id", "\x01", 1), "_graph": F.substring_index("graph_id", "\x01", -1)})
    cells = [F.max(F.when(F.col("_net") == n, F.col(m))).alias(f"{n}_{m}") for n in networks for m in measures]
    return split.groupBy(F.col("_graph").alias("graph_id")).agg(*cells)


def sizes(nodes: DataFrame, edges: DataFrame, events: DataFrame, dialogue: DataFrame, passages: DataFrame) -> DataFrame:
    """(graph_id, n_locations, n_dialogue, n_passages, max_degree_name): what the measures of a graph are read beside; names tie by id."""
    ids = nodes.select("graph_id").distinct()
    best = degrees(simple(edges), nodes.select("graph_id", "id").distinct()).join(nodes.groupBy("graph_id", "id").agg(F.min("name").alias("name")), ["graph_id", "id"])
    best = best.groupBy("graph_id").agg(F.min_by("name", F.struct(-F.col("degree"), F.col("id"))).alias("max_degree_name"))
    places = events.filter("`where` <> ''").groupBy("graph_id").agg(F.count_distinct("where").alias("n_locations"))
    said = dialogue.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_dialogue"))
    read_ = passages.groupBy("graph_id").agg(F.count_distinct("passage").alias("n_passages"))
    out = ids.join(places, "graph_id", "left").join(said, "graph_id", "left").join(read_, "graph_id", "left").join(best, "graph_id", "left")
    return out.select("graph_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_locations", "n_dialogue", "n_passages")], "max_degree_name")


def text_profile(characters: DataFrame, events: DataFrame, name_class, macro: Mapping[str, Sequence[str]] = MACRO) -> DataFrame:
    """One row per graph: characters, share of women among those with a sex, shares of the classes of names, shares of the kinds of events.

    characters: (graph_id, id, name, gender); events: (graph_id, what); name_class: a function of the name.
    """
    kinds = ("type", "realistic", "classical", "other", "unknown")
    known = F.col("gender").isin("male", "female")
    share = lambda c, of: F.round(c / F.nullif(of, F.lit(0)), 6)
    people = characters.withColumn("_class", name_class(F.col("name"))).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_characters"), share(F.count_if(F.col("gender") == "female"), F.count_if(known)).alias("female_share"), *[share(F.count_if(F.col("_class") == k), F.count(F.lit(1))).alias(f"name_{k}") for k in kinds]
    )
    verb = F.lower("what")
    acts = events.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_events"), *[share(F.count_if(verb.isin(list(vs))), F.count(F.lit(1))).alias(f"macro_{k}") for k, vs in macro.items()])
    return people.join(acts, "graph_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("bigint")))
