import itertools
import random

from folioscope.operators import graph as G


def table(spark, pairs, n):
    rel = spark.createDataFrame([("g", f"n{a}", f"n{b}", "t", i) for i, (a, b) in enumerate(pairs)], "graph_id string, a string, b string, type string, ord int")
    return rel, spark.createDataFrame([("g", f"n{i}") for i in range(n)], "graph_id string, id string")


def brute(pairs, n):
    """Betweenness by listing all shortest paths."""
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = [0.0] * n
    for s, t in itertools.permutations(range(n), 2):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            seen = {v for p in paths for v in p}
            paths = [p + [v] for p in paths for v in near[p[-1]] if v not in seen]
        found = [p for p in paths if p[-1] == t]
        for p in found:
            for v in p[1:-1]:
                score[v] += 1 / len(found)
    return [x / ((n - 1) * (n - 2)) for x in score]


def test_betweenness_against_all_paths(spark, monkeypatch):
    monkeypatch.setattr(G, "SOURCES", 3)
    rng = random.Random(4)
    for _ in range(3):
        n = 8
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(11)]
        rel, nodes = table(spark, pairs, n)
        got = {r.id: r.betweenness for r in G.paths(G.undirected(rel, nodes), nodes).collect()}
        for i, x in enumerate(brute(pairs, n)):
            assert abs(got[f"n{i}"] - x) < 1e-9


def test_triangles_and_clustering(spark):
    rel, nodes = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 2), (3, 3)], 5)
    e = G.undirected(rel, nodes)
    assert {r.id: r.triangles for r in G.triangles(e).collect()} == {"n0": 1, "n1": 1, "n2": 1}
    c = G.clustering(e, nodes).first()
    assert abs(c.clustering - (1 + 1 + 1 / 3) / 5) < 1e-9 and abs(c.transitivity - 3 / 5) < 1e-9
    assert {r.id: r.degree for r in G.degrees(e, nodes).collect()} == {"n0": 2, "n1": 2, "n2": 3, "n3": 3, "n4": 0}


def test_edges_need_known_ends_and_skip_same_as(spark):
    rel = spark.createDataFrame([("g", "n0", "n1", "b", 1), ("g", "n1", "n0", "a", 0), ("g", "n0", "x", "a", 2), ("g", "n0", "n1", "same_as", 3), ("h", "n0", "n1", "a", 4)], "graph_id string, a string, b string, type string, ord int")
    nodes = spark.createDataFrame([("g", "n0"), ("g", "n1")], "graph_id string, id string")
    u = G.undirected(rel, nodes, exclude=()).collect()
    assert [(r.a, r.b, r.weight, r.type, r.types) for r in u] == [("n0", "n1", 2, "a", ["a", "b"])]
    assert G.directed(rel, nodes, only=["b"]).count() == 1


def test_profile_of_parts(spark):
    rel, nodes = table(spark, [(0, 1), (1, 2)], 4)
    p = G.profile(G.undirected(rel, nodes), nodes).first()
    assert (p.components, p.largest_cc_frac, p.diameter, p.n_edges) == (2, 0.75, None, 2)
    rel, nodes = table(spark, [(0, 1), (1, 2)], 3)
    p = G.profile(G.directed(rel, nodes), nodes, True).first()
    assert (p.components, p.diameter, p.avg_path, p.reciprocity, p.max_betweenness) == (1, 2, 1.33, 0.0, 1.0)


def test_order_by_passage_number(spark):
    e = spark.createDataFrame([("g", "x", "w", "b", "P1000", 0), ("g", "x", "w", "a", "P999", 1), ("g", "x", "w", "", "P1", 2)], "graph_id string, who string, what string, `where` string, passage string, ord int")
    assert G.trajectories(e).first().steps == ["999/a/w", "1000/b/w"]
    assert {r.location: (r.first_passage, r.n_events) for r in G.locations(e).collect()} == {"a": (999, 1), "b": (1000, 1)}


def test_paths_of_a_large_graph_with_trees_in_blocks(spark, monkeypatch):
    """A cast of 60,000 with a ring, chains and fans hanging on it, beside small graphs: taking off trees and dealing sources to blocks leaves all measures as they are."""
    monkeypatch.setattr(G, "SOURCES", 20_000)
    monkeypatch.setattr(G, "SLOTS", 5_000)
    ring, n = 40, 60_000
    pairs = [(i, (i + 1) % ring) for i in range(ring)] + [(i - ring if i < 2 * ring else i % 2 * ring + i % ring, i) for i in range(ring, n)]
    rel, nodes = table(spark, pairs, n)
    small = [("h", "n0", "n1", "t", 0), ("h", "n2", "n3", "t", 1), ("h", "n3", "n4", "t", 2)]
    rel = rel.unionByName(spark.createDataFrame(small, rel.schema))
    nodes = nodes.unionByName(spark.createDataFrame([("h", f"n{i}") for i in range(6)], nodes.schema))
    got = {(r.graph_id, r.id): r for r in G.paths(G.undirected(rel, nodes), nodes).collect()}
    hung, weight = [0] * n, [1] * n
    for a, b in reversed(pairs[ring:]):
        weight[a] += weight[b]
    for a, b in pairs[ring:]:
        hung[a] += weight[b] ** 2
    distance = [[min(abs(i - j), ring - abs(i - j)) for j in range(ring)] for i in range(ring)]
    for v in range(ring):
        through = sum(weight[s] * weight[t] * (0.5 if distance[s][t] * 2 == ring else 1) for s in range(ring) for t in range(ring) if v not in (s, t) and s != t and distance[s][v] + distance[v][t] == distance[s][t])
        want = (weight[v] - 1) ** 2 - hung[v] + 2 * (weight[v] - 1) * (n - weight[v]) + through
        assert abs(got["g", f"n{v}"].betweenness - want / ((n - 1) * (n - 2))) < 1e-9
    assert len(got) == n + 6 and got["g", "n0"].n_components == 1 and got["g", "n0"].diameter == ring // 2 + 4
    h = got["h", "n3"]
    assert (h.n_components, h.largest, h.diameter, h.betweenness) == (3, 3, 2, 2 / 20) and abs(h.mean_path - 4 / 3) < 1e-12


def test_profiles_search_no_paths_for_counts_of_components(spark, monkeypatch):
    rel, nodes = table(spark, [(0, 1), (1, 0), (1, 2), (3, 4), (5, 5)], 7)
    u, d = G.undirected(rel, nodes), G.directed(rel, nodes)
    whole = {(w, r.graph_id): r for w, e in ((False, u), (True, d)) for r in G.profile(e, nodes, w).collect()}
    monkeypatch.setattr(G, "_between", None)
    monkeypatch.setattr(G, "paths", None)
    some = ["n_nodes", "n_edges", "density", "components", "largest_cc_frac", "reciprocity"]
    for way, e in ((False, u), (True, d)):
        r = G.profile(e, nodes, way, some).first()
        assert [r[m] for m in some] == [whole[way, "g"][m] for m in some]
    p = G.profiles({"x": (u, False), "y": (d, True)}, nodes, ["density", "components"]).first()
    assert (p.x_components, p.y_components) == (4, 4) and (p.x_density, p.y_density) == (whole[False, "g"].density, whole[True, "g"].density)
