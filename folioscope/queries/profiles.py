"""Profiles of texts and graphs, restrictions by genre and match group, prompts from metadata, human edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import graph as G
from folioscope.operators import segment as S
from folioscope.operators import stats as T
from folioscope.operators import store
from folioscope.queries import networks as N
from folioscope.runtime import read


def _tags(s, d):
    return read(s, d, "genre_lite").select("_id", F.explode("genre_tags").alias("tag")).filter("tag IS NOT NULL")


def genre_restrict(s, d):
    """Passages of the works that carry a tag."""
    works = _tags(s, d).filter("tag = 'novel'").select("_id")
    return read(s, d, "passage_content").join(works, "_id", "left_semi").groupBy("_id").agg(F.count(F.lit(1)).alias("n"))


RESTRICT = "SELECT _id, count(*) AS n FROM passage_content WHERE _id IN (SELECT _id FROM genre_lite WHERE list_contains(genre_tags, 'novel')) GROUP BY 1"


def novel_only(s, d):
    """Works with passages that no tag marks as something other than a novel."""
    other = _tags(s, d).filter("tag <> 'novel'").select("_id")
    return read(s, d, "passage_content").select("_id").distinct().join(other, "_id", "left_anti")


ONLY = "SELECT DISTINCT _id FROM passage_content p WHERE NOT EXISTS (SELECT 1 FROM (SELECT _id, unnest(genre_tags) AS tag FROM genre_lite) g WHERE g._id = p._id AND tag <> 'novel')"


def match_group_tags(s, d):
    return store.of_same_text(read(s, d, "texts"), _tags(s, d))


GROUP_TAGS = """WITH t AS (SELECT DISTINCT _id, tag FROM (SELECT _id, unnest(genre_tags) AS tag FROM genre_lite) WHERE tag IS NOT NULL), g AS (SELECT DISTINCT _id, match_group FROM texts WHERE match_group IS NOT NULL)
SELECT _id, tag FROM t UNION SELECT h._id, t.tag FROM t JOIN g USING (_id) JOIN g h ON h.match_group = g.match_group"""


def audit_table(s, d):
    """Every text with its result, where there is one."""
    results = read(s, d, "genre_lite").groupBy("_id").agg(F.max("year_estimated").alias("year_estimated"))
    return read(s, d, "texts").join(results, "_id", "left").select("_id", "title", "year", "year_estimated", F.col("year_estimated").isNotNull().alias("annotated"))


AUDIT = "SELECT _id, title, year, year_estimated, year_estimated IS NOT NULL AS annotated FROM texts LEFT JOIN (SELECT _id, max(year_estimated) AS year_estimated FROM genre_lite GROUP BY 1) USING (_id)"


def recognised_texts(s, d):
    guesses = read(s, d, "genre_lite").groupBy("_id").agg(F.max_by("author_first_name", F.struct("year_estimated", "author_first_name")).alias("first_name"), F.max("year_estimated").alias("estimated"))
    known = X.recognised(F.col("estimated"), F.col("year"), F.col("author"), F.col("first_name"))
    return read(s, d, "texts").join(guesses, "_id").select("_id", known.alias("recognised"))


RECOGNISED = r"""WITH g AS (SELECT _id, arg_max(author_first_name, (year_estimated, author_first_name)) FILTER (year_estimated IS NOT NULL OR author_first_name IS NOT NULL) AS f, max(year_estimated) AS y FROM genre_lite GROUP BY 1)
SELECT _id, coalesce(y = year AND (regexp_full_match(lower(coalesce(trim(author), '')), '(anon(ymous)?\.?|unknown)?') OR (lower(trim(f)) <> '' AND contains(lower(author), lower(trim(f))))), false) AS recognised FROM texts JOIN g USING (_id)"""


def meta_prompts(s, d):
    t = read(s, d, "texts")
    return t.select("_id", S.meta_prompt(F.col("title"), F.col("author"), F.col("year"), F.col("genre"), F.col("corpus")).alias("prompt"))


META = """SELECT _id, concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN 'Title: ' || trim(title) END, CASE WHEN trim(author) <> '' THEN 'Author: ' || trim(author) END,
CASE WHEN year IS NOT NULL THEN 'Printed: ' || CAST(floor(year / 50.0) * 50 AS BIGINT) || '-' || CAST(floor(year / 50.0) * 50 + 49 AS BIGINT) END, CASE WHEN trim(genre) <> '' THEN 'Subjects: ' || trim(genre) END, CASE WHEN trim(corpus) <> '' THEN 'Form: ' || trim(corpus) END) AS prompt FROM texts"""


def word_prompts(s, d):
    return read(s, d, "new_characters").select("name_id", S.word_prompt(F.col("name"), F.col("social_class")).alias("prompt"))


WORDS = "SELECT name_id, CASE WHEN coalesce(trim(social_class), '') = '' THEN name ELSE name || ' [' || trim(social_class) || ']' END AS prompt FROM new_characters"


def human_edits(s, d):
    """The last value that each annotator gave to a field of a passage, as edits."""
    a = read(s, d, "passage_annotations").filter("value IS NOT NULL")
    edits = a.select(F.concat_ws("::", "_id", "scheme", F.col("seq").cast("string"), "field").alias("key"), F.col("source_agent").alias("annotator"), F.col("value").alias("edit"), F.col("annotated_at").alias("edited_at"))
    return store.latest_edits(edits).select("key", "annotator", "edit")


EDITS = "SELECT concat_ws('::', _id, scheme, seq, field) AS key, source_agent AS annotator, arg_max(value, (annotated_at, value)) AS edit FROM passage_annotations WHERE value IS NOT NULL GROUP BY 1, 2"


def _sized(s, d):
    return read(s, d, "documents").select("form", "year", F.col("n_chars").cast("double").alias("chars"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("double").alias("runs"))


def decade_means(s, d):
    m = T.means_by_decade(_sized(s, d), "year", ["chars", "runs"])
    return m.select("decade", "n", F.round("chars", 6).alias("chars"), F.round("runs", 6).alias("runs"))


DECADES = "SELECT CAST(floor(year / 10.0) * 10 AS BIGINT) AS decade, count(*) AS n, round(avg(n_chars), 6) AS chars, round(avg(len(string_split(coalesce(text, ''), ' '))), 6) AS runs FROM documents WHERE year IS NOT NULL GROUP BY 1"


def form_means(s, d):
    m = T.means_by_tag(_sized(s, d), "form", ["chars", "runs"], top=3)
    return m.select("tag", "n", F.round("chars", 6).alias("chars"), F.round("runs", 6).alias("runs"))


FORMS = "SELECT form AS tag, count(*) AS n, round(avg(n_chars), 6) AS chars, round(avg(len(string_split(coalesce(text, ''), ' '))), 6) AS runs FROM documents WHERE form <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 3"


def size_correlations(s, d):
    c = T.correlations(_sized(s, d), "chars", ["runs", "year"])
    return c.select("metric", "n", F.round("r", 6).alias("r"))


CORRELATIONS = """WITH x AS (SELECT ln(1 + n_chars) AS x, len(string_split(coalesce(text, ''), ' '))::DOUBLE AS runs, year::DOUBLE AS year FROM documents WHERE n_chars IS NOT NULL)
SELECT 'runs' AS metric, count(runs) AS n, round(corr(x, runs), 6) AS r FROM x UNION ALL SELECT 'year', count(year), round(corr(x, year) FILTER (year IS NOT NULL), 6) FROM x"""


def tag_matrix(s, d):
    tags = _tags(s, d).join(read(s, d, "genre_lite").groupBy("_id").agg(F.max("year_estimated").alias("y")), "_id")
    return T.group_matrix(tags, ["_id"], "tag", ["novel", "tale", "romance"], "y")


MATRIX = "SELECT _id, max(y) FILTER (tag = 'novel') AS novel, max(y) FILTER (tag = 'tale') AS tale, max(y) FILTER (tag = 'romance') AS romance FROM (SELECT _id, unnest(genre_tags) AS tag FROM genre_lite) JOIN (SELECT _id, max(year_estimated) AS y FROM genre_lite GROUP BY 1) USING (_id) WHERE tag IS NOT NULL GROUP BY 1"


def text_profiles(s, d):
    people = read(s, d, "new_characters").select(F.col("_id").alias("graph_id"), "id", "name", "gender")
    macro = {"marriage": ["woos", "wed_to"], "conflict": ["deceives", "feud_with"]}
    return G.text_profile(people, N._events(s, d), X.classify_name, macro)


def graph_sizes(s, d):
    return G.sizes(N._nodes(s, d), G.undirected(N._rel(s, d), N._nodes(s, d)), N._events(s, d), N._dialogue(s, d), N._rel(s, d).filter("passage IS NOT NULL"))


SIZES = f"""WITH {N._B}, ev AS (SELECT _id AS graph_id, count(DISTINCT detail) AS n FROM relations WHERE type IN ('deceives', 'woos', 'wed_to', 'feud_with') AND detail <> '' GROUP BY 1), di AS (SELECT _id AS graph_id, count(*) AS n FROM relations WHERE type = 'companion_of' GROUP BY 1),
pa AS (SELECT _id AS graph_id, count(DISTINCT passage) AS n FROM relations GROUP BY 1), nm AS (SELECT _id AS graph_id, id, min(name) AS name FROM new_characters GROUP BY 1, 2), top AS (SELECT graph_id, arg_min(name, (-degree, id)) AS max_degree_name FROM dg JOIN nm USING (graph_id, id) GROUP BY 1)
SELECT graph_id, coalesce(ev.n, 0) AS n_locations, coalesce(di.n, 0) AS n_dialogue, coalesce(pa.n, 0) AS n_passages, max_degree_name FROM (SELECT DISTINCT graph_id FROM n) LEFT JOIN ev USING (graph_id) LEFT JOIN di USING (graph_id) LEFT JOIN pa USING (graph_id) LEFT JOIN top USING (graph_id)"""


def network_profiles(s, d):
    """Density and reach of four networks of each work, side by side."""
    r, n = N._rel(s, d), N._nodes(s, d)
    networks = {
        "relation": (G.undirected(r, n), False), "directed": (G.directed(r, n, only=["owes", "heir_of"]), True),
        "dialogue": (G.interactions(N._dialogue(s, d), n, "speaker", "addressee", "gist"), False), "event": (G.interactions(N._events(s, d), n, "who", "whom", "what"), False),
    }
    return G.profiles(networks, n, ["n_nodes", "n_edges", "density", "components"])


QUERIES = {"genre_restrict": genre_restrict, "novel_only": novel_only, "match_group_tags": match_group_tags, "audit_table": audit_table, "recognised_texts": recognised_texts, "meta_prompts": meta_prompts, "word_prompts": word_prompts, "human_edits": human_edits, "decade_means": decade_means, "form_means": form_means, "size_correlations": size_correlations, "tag_matrix": tag_matrix, "text_profiles": text_profiles, "graph_sizes": graph_sizes, "network_profiles": network_profiles}
ORACLES = {"genre_restrict": RESTRICT, "novel_only": ONLY, "match_group_tags": GROUP_TAGS, "audit_table": AUDIT, "recognised_texts": RECOGNISED, "meta_prompts": META, "word_prompts": WORDS, "human_edits": EDITS, "decade_means": DECADES, "form_means": FORMS, "size_correlations": CORRELATIONS, "tag_matrix": MATRIX, "graph_sizes": SIZES}
