"""Networks of characters: the works are graphs, relations are edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import graph as G
from folioscope.operators.stats import gini as gini_of
from folioscope.runtime import read

EVENTS = ["deceives", "woos", "wed_to", "feud_with"]


def _nodes(s, d):
    return read(s, d, "new_characters").select(F.col("_id").alias("graph_id"), "id", "name", "notes", "chunk")


def _rel(s, d):
    return read(s, d, "relations").select(F.col("_id").alias("graph_id"), "a", "b", "type", F.col("rel_id").alias("ord"), "passage", "detail")


def _events(s, d):
    return _rel(s, d).filter(F.col("type").isin(EVENTS)).select("graph_id", F.col("a").alias("who"), F.col("b").alias("whom"), F.col("type").alias("what"), F.col("detail").alias("where"), "passage", "ord")


def _dialogue(s, d):
    return _rel(s, d).filter("type = 'companion_of'").select("graph_id", F.col("a").alias("speaker"), F.col("b").alias("addressee"), F.coalesce("detail", F.lit("")).alias("gist"), "ord")


_B = """n AS (SELECT DISTINCT _id AS graph_id, id FROM new_characters),
r AS (SELECT _id AS graph_id, a, b, type, rel_id AS ord, passage, detail FROM relations),
k AS (SELECT r.* FROM r SEMI JOIN n ON n.graph_id = r.graph_id AND n.id = r.a SEMI JOIN n m ON m.graph_id = r.graph_id AND m.id = r.b),
u AS (SELECT graph_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight, arg_min(type, ord) AS type, array_to_string(list(type ORDER BY type), '|') AS types FROM k WHERE type <> 'same_as' GROUP BY 1, 2, 3),
e AS (SELECT DISTINCT graph_id, a, b FROM u WHERE a < b),
dg AS (SELECT n.graph_id, n.id, coalesce(x.k, 0) AS degree FROM n LEFT JOIN (SELECT graph_id, id, count(*) AS k FROM (SELECT graph_id, a AS id FROM e UNION ALL SELECT graph_id, b FROM e) GROUP BY 1, 2) x USING (graph_id, id))"""


def _flat(df):
    return df.withColumn("types", F.array_join("types", "|"))


def edges_undirected(s, d):
    return _flat(G.undirected(_rel(s, d), _nodes(s, d)))


def edges_directed(s, d):
    return _flat(G.directed(_rel(s, d), _nodes(s, d), only=["owes", "heir_of"]))


DIRECTED = f"WITH {_B} SELECT graph_id, a, b, count(*) AS weight, arg_min(type, ord) AS type, array_to_string(list(type ORDER BY type), '|') AS types FROM k WHERE type IN ('owes', 'heir_of') GROUP BY 1, 2, 3"


def edges_dialogue(s, d):
    return G.interactions(_dialogue(s, d), _nodes(s, d), "speaker", "addressee", "gist").withColumn("payload", F.array_join("payload", "|"))


DIALOGUE = f"WITH {_B} SELECT graph_id, a, b, count(*) AS weight, array_to_string(list(coalesce(detail, '') ORDER BY ord), '|') AS payload FROM k WHERE type = 'companion_of' GROUP BY 1, 2, 3"


def edges_composite(s, d):
    rest = _rel(s, d).filter(~F.col("type").isin([*EVENTS, "companion_of"]))
    c = G.composite(rest, _events(s, d), _dialogue(s, d), _nodes(s, d))
    return c.withColumns({x: F.array_join(x, "|") for x in ("rel_types", "event_verbs")})


COMPOSITE = f"""WITH {_B} SELECT graph_id, a, b, count(*) AS weight, coalesce(string_agg(type, '|' ORDER BY ord) FILTER (type NOT IN ('deceives', 'woos', 'wed_to', 'feud_with', 'companion_of')), '') AS rel_types,
 coalesce(string_agg(type, '|' ORDER BY ord) FILTER (type IN ('deceives', 'woos', 'wed_to', 'feud_with')), '') AS event_verbs, count(*) FILTER (type = 'companion_of') AS n_dialogue FROM k WHERE type <> 'same_as' GROUP BY 1, 2, 3"""


def degree_top(s, d):
    return G.top_characters(G.degrees(G.simple(G.undirected(_rel(s, d), _nodes(s, d))), _nodes(s, d)), "degree", 3)


DEGREE = f"WITH {_B} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, id) AS rank FROM dg) WHERE rank <= 3"


def active_nodes(s, d):
    n = _nodes(s, d).select("graph_id", "id").distinct()
    return G.active(G.interactions(_dialogue(s, d), n, "speaker", "addressee", "gist"), n)


ACTIVE = f"WITH {_B} SELECT DISTINCT graph_id, a AS id FROM k WHERE type = 'companion_of' UNION SELECT DISTINCT graph_id, b FROM k WHERE type = 'companion_of'"


def density_reciprocity(s, d):
    b = G.basics(G.directed(_rel(s, d), _nodes(s, d)), _nodes(s, d), True)
    return b.select("graph_id", "n_nodes", "n_edges", F.round("density", 8).alias("density"), F.round("reciprocity", 8).alias("reciprocity"), F.round("mean_degree", 8).alias("mean_degree"), "max_degree", "max_degree_node")


DENSITY = f"""WITH {_B}, d AS (SELECT DISTINCT graph_id, a, b FROM k WHERE type <> 'same_as'), dd AS (SELECT n.graph_id, n.id, coalesce(x.k, 0) AS degree FROM n LEFT JOIN (SELECT graph_id, id, count(*) AS k FROM (SELECT graph_id, a AS id FROM d UNION ALL SELECT graph_id, b FROM d) GROUP BY 1, 2) x USING (graph_id, id)),
ne AS (SELECT graph_id, count(*) AS n_edges FROM d GROUP BY 1), mu AS (SELECT graph_id, count(*) AS m FROM d SEMI JOIN (SELECT graph_id AS g, b AS x, a AS y FROM d) z ON z.g = d.graph_id AND z.x = d.a AND z.y = d.b WHERE a <> b GROUP BY 1)
SELECT dd.graph_id, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges, round(coalesce(any_value(n_edges)::DOUBLE / nullif(count(*) * (count(*) - 1), 0), 0), 8) AS density, round(coalesce(coalesce(any_value(m), 0)::DOUBLE / nullif(any_value(n_edges), 0), 0), 8) AS reciprocity,
 round(avg(degree), 8) AS mean_degree, max(degree) AS max_degree, arg_min(id, (-degree, id)) AS max_degree_node FROM dd LEFT JOIN ne USING (graph_id) LEFT JOIN mu USING (graph_id) GROUP BY 1"""


def clustering_transitivity(s, d):
    c = G.clustering(G.undirected(_rel(s, d), _nodes(s, d)), _nodes(s, d))
    return c.select("graph_id", F.round("clustering", 8).alias("clustering"), F.round("transitivity", 8).alias("transitivity"))


CLUSTER = f"""WITH {_B}, t AS (SELECT x.graph_id, x.a AS p, x.b AS q, y.b AS s FROM e x JOIN e y ON y.graph_id = x.graph_id AND y.a = x.b SEMI JOIN e z ON z.graph_id = x.graph_id AND z.a = x.a AND z.b = y.b),
tt AS (SELECT graph_id, id, count(*) AS t FROM (SELECT graph_id, p AS id FROM t UNION ALL SELECT graph_id, q FROM t UNION ALL SELECT graph_id, s FROM t) GROUP BY 1, 2)
SELECT graph_id, round(avg(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2.0::DOUBLE) ELSE 0 END), 8) AS clustering, round(coalesce(sum(coalesce(t, 0)) / nullif(sum(degree * (degree - 1) / 2.0::DOUBLE), 0), 0), 8) AS transitivity
FROM dg LEFT JOIN tt USING (graph_id, id) GROUP BY 1"""


def gini_degree(s, d):
    k = G.degrees(G.simple(G.undirected(_rel(s, d), _nodes(s, d))), _nodes(s, d))
    return gini_of(k, ["graph_id"], "degree").select("graph_id", F.round("gini", 8).alias("gini"))


GINI = f"""WITH {_B} SELECT graph_id, round(CASE WHEN count(*) < 2 OR sum(degree) = 0 THEN 0 ELSE 2 * sum(r * degree)::DOUBLE / (count(*) * nullif(sum(degree), 0)) - (count(*) + 1) / count(*)::DOUBLE END, 8) AS gini
FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree) AS r FROM dg) GROUP BY 1"""


def location_summary(s, d):
    return G.locations(_events(s, d)).withColumn("characters", F.array_join("characters", "|"))


LOCATIONS = r"""SELECT _id AS graph_id, detail AS location, count(*) AS n_events, count(DISTINCT a) AS n_characters, coalesce(array_to_string(list(DISTINCT a ORDER BY a) FILTER (a IS NOT NULL), '|'), '') AS characters,
 min(TRY_CAST(regexp_extract(passage, '(\d+)', 1) AS INT)) AS first_passage, max(TRY_CAST(regexp_extract(passage, '(\d+)', 1) AS INT)) AS last_passage FROM relations WHERE type IN ('deceives', 'woos', 'wed_to', 'feud_with') AND detail <> '' GROUP BY 1, 2"""


def trajectories(s, d):
    return G.trajectories(_events(s, d)).withColumn("steps", F.array_join("steps", "|"))


TRAJECTORIES = r"""SELECT _id AS graph_id, a AS who, string_agg(concat_ws('/', TRY_CAST(regexp_extract(passage, '(\d+)', 1) AS INT)::VARCHAR, detail, type), '|' ORDER BY TRY_CAST(regexp_extract(passage, '(\d+)', 1) AS INT) NULLS FIRST, rel_id) AS steps
FROM relations WHERE type IN ('deceives', 'woos', 'wed_to', 'feud_with') AND detail <> '' AND a <> '' GROUP BY 1, 2"""


def verb_counts(s, d):
    return G.counts(_rel(s, d), "type", ["same_as"])


VERBS = "SELECT _id AS graph_id, type, count(*) AS n FROM relations WHERE type <> 'same_as' GROUP BY 1, 2"


def macro_counts(s, d):
    return G.macro_counts(_events(s, d), "what", {"courtship": ["woos", "wed_to"], "conflict": ["feud_with", "deceives"], "deception": ["deceives"]})


MACRO = "SELECT _id AS graph_id, count(*) FILTER (type IN ('woos', 'wed_to')) AS courtship, count(*) FILTER (type IN ('feud_with', 'deceives')) AS conflict, count(*) FILTER (type = 'deceives') AS deception FROM relations WHERE type IN ('deceives', 'woos', 'wed_to', 'feud_with') GROUP BY 1"


def top_verb(s, d):
    return G.top_label(G.directed(_rel(s, d), _nodes(s, d)), "types")


TOP_VERB = f"WITH {_B}, c AS (SELECT graph_id, a, b, type, count(*) AS n FROM k WHERE type <> 'same_as' GROUP BY ALL) SELECT graph_id, a, b, arg_min(type, (-n, type)) AS label, max(n) AS n FROM c GROUP BY ALL"


def graph_components(s, d):
    labels = G.components(G.undirected(_rel(s, d), _nodes(s, d)), _nodes(s, d))
    sizes = labels.groupBy("graph_id", "root").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return sizes.groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("n_components"), F.max("size").alias("largest"))


COMPONENTS = f"""WITH RECURSIVE {_B}, w AS (SELECT graph_id, a, b FROM e UNION ALL SELECT graph_id, b, a FROM e), reach AS (SELECT graph_id, id AS m, id AS root FROM n UNION SELECT reach.graph_id, w.b, reach.root FROM reach JOIN w ON w.graph_id = reach.graph_id AND w.a = reach.m),
lab AS (SELECT graph_id, m, min(root) AS root FROM reach GROUP BY 1, 2), sz AS (SELECT graph_id, root, count(*) AS z FROM lab GROUP BY 1, 2) SELECT graph_id, CAST(count(*) AS INT) AS n_components, CAST(max(z) AS INT) AS largest FROM sz GROUP BY 1"""


def path_metrics(s, d):
    return G.profile(G.undirected(_rel(s, d), _nodes(s, d)), _nodes(s, d))


def betweenness(s, d):
    p = G.paths(G.undirected(_rel(s, d), _nodes(s, d)), _nodes(s, d))
    return G.top_characters(p.select("graph_id", "id", F.round("betweenness", 8).alias("betweenness")), "betweenness", 3)


def merged_register(s, d):
    m = _nodes(s, d).select("graph_id", "id", "name", F.col("chunk").alias("seen"), "notes")
    return G.register(m, _rel(s, d)).withColumn("aliases", F.array_join("aliases", "|"))


MERGED = """WITH RECURSIVE n AS (SELECT _id AS graph_id, id, name, chunk, notes FROM new_characters),
k AS (SELECT DISTINCT r._id AS graph_id, r.a, r.b FROM relations r SEMI JOIN n ON n.graph_id = r._id AND n.id = r.a SEMI JOIN n m ON m.graph_id = r._id AND m.id = r.b WHERE r.type = 'same_as'),
w AS (SELECT graph_id, a, b FROM k UNION SELECT graph_id, b, a FROM k),
reach AS (SELECT graph_id, id AS m, id AS root FROM n UNION SELECT reach.graph_id, w.b, reach.root FROM reach JOIN w ON w.graph_id = reach.graph_id AND w.a = reach.m),
l AS (SELECT graph_id, m AS id, min(root) AS root FROM reach GROUP BY 1, 2),
x AS (SELECT n.*, root, row_number() OVER (PARTITION BY graph_id, root ORDER BY id, name, notes) AS r FROM n JOIN l USING (graph_id, id))
SELECT graph_id, root, max(name) FILTER (r = 1) AS name, coalesce(string_agg(name, '|' ORDER BY r) FILTER (r > 1), '') AS aliases, min(chunk) AS first_seen, max(chunk) AS last_seen, coalesce(string_agg(notes, '; ' ORDER BY r) FILTER (notes <> ''), '') AS notes FROM x GROUP BY 1, 2"""

QUERIES = {"edges_undirected": edges_undirected, "edges_directed": edges_directed, "edges_dialogue": edges_dialogue, "edges_composite": edges_composite, "degree_top": degree_top, "active_nodes": active_nodes, "density_reciprocity": density_reciprocity, "clustering_transitivity": clustering_transitivity, "gini_degree": gini_degree, "location_summary": location_summary, "trajectories": trajectories, "verb_counts": verb_counts, "macro_counts": macro_counts, "top_verb": top_verb, "graph_components": graph_components, "path_metrics": path_metrics, "betweenness": betweenness, "merged_register": merged_register}
ORACLES = {"edges_undirected": f"WITH {_B} SELECT * FROM u", "edges_directed": DIRECTED, "edges_dialogue": DIALOGUE, "edges_composite": COMPOSITE, "degree_top": DEGREE, "active_nodes": ACTIVE, "density_reciprocity": DENSITY, "clustering_transitivity": CLUSTER, "gini_degree": GINI, "location_summary": LOCATIONS, "trajectories": TRAJECTORIES, "verb_counts": VERBS, "macro_counts": MACRO, "top_verb": TOP_VERB, "graph_components": COMPONENTS, "merged_register": MERGED}
