"""Features, groups, exact tests, rates and other statistics of annotated passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import values as V
from folioscope.operators import stats as T
from folioscope.queries.agreement import READ as AGREEMENT_READ
from folioscope.queries.agreement import _votes as latest_votes
from folioscope.runtime import Workspace, read

KEY = ["_id", "scheme", "seq"]


def _label(c):
    return F.regexp_replace(F.lower(F.trim(c)), r"[ \-]+", "_")


def passages(s, d):
    """Each passage of the content table once: labels in one spelling, a passage is prose if any of its rows says so."""
    p = read(s, d, "passage_content")
    lists = {c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _label), lambda x: x.isNotNull() & (x != "")) for c in ("scene_content", "setting")}
    rows = p.select(*KEY, "is_prose_fiction", *[v.alias(k) for k, v in lists.items()])
    return Workspace(s, "passages").keep(rows.groupBy(*KEY).agg(F.max("is_prose_fiction").alias("is_prose_fiction"), F.array_distinct(F.flatten(F.collect_list("scene_content"))).alias("scene_content"), F.array_distinct(F.flatten(F.collect_list("setting"))).alias("setting")))


def features(s, d, p=None):
    p = passages(s, d) if p is None else p
    content = T.expand_booleans(p, KEY, {"is_prose_fiction": "bool", "scene_content": "list"}, "content.")
    place = T.expand_booleans(p, KEY, {"setting": "list"}, "place.")
    return content, place


def tags(s, d, p=None):
    p = passages(s, d) if p is None else p
    g = read(s, d, "genre_lite").select("_id", F.explode("genre_tags").alias("tag")).select("_id", F.regexp_replace(F.lower(F.trim("tag")), "-", " ").alias("tag")).filter("tag <> ''").distinct()
    return p.select(*KEY).join(g, "_id").select(F.struct(*KEY).alias("k"), "tag")


def members(s, d, least=30, p=None):
    p = passages(s, d) if p is None else p
    t = p.select(*KEY).join(read(s, d, "texts").select("_id", "year"), "_id").select(F.struct(*KEY).alias("k"), "year")
    g = T.groups(t, tags(s, d, p), "k", F.col("year"), "tag", least)
    return g.select("k.*", "grp", "kind")


_BASE = r"""
raw AS (SELECT _id, scheme, seq, is_prose_fiction, scene_content, setting FROM passage_content),
flag AS (SELECT _id, scheme, seq, bool_or(is_prose_fiction) AS is_prose_fiction FROM raw GROUP BY ALL),
sc AS (SELECT DISTINCT _id, scheme, seq, regexp_replace(lower(trim(x)), '[ \-]+', '_', 'g') AS x FROM (SELECT _id, scheme, seq, unnest(scene_content) AS x FROM raw) WHERE trim(x) <> ''),
st AS (SELECT DISTINCT _id, scheme, seq, regexp_replace(lower(trim(x)), '[ \-]+', '_', 'g') AS x FROM (SELECT _id, scheme, seq, unnest(setting) AS x FROM raw) WHERE trim(x) <> ''),
content AS (SELECT _id, scheme, seq, 'content.is_prose_fiction' AS feature FROM flag WHERE is_prose_fiction UNION ALL SELECT _id, scheme, seq, 'content.scene_content:' || x FROM sc),
place AS (SELECT _id, scheme, seq, 'place.setting:' || x AS feature FROM st),
feats AS (SELECT * FROM content UNION ALL SELECT * FROM place),
gt AS (SELECT DISTINCT _id, replace(lower(trim(tag)), '-', ' ') AS tag FROM (SELECT _id, unnest(genre_tags) AS tag FROM genre_lite) WHERE trim(tag) <> ''),
kt AS (SELECT _id, scheme, seq, tag FROM flag JOIN gt USING (_id)),
kh AS (SELECT _id, scheme, seq, CAST(floor(year / 50.0) * 50 AS BIGINT) || '-' || CAST(floor(year / 50.0) * 50 + 49 AS BIGINT) AS h FROM flag JOIN texts USING (_id) WHERE year IS NOT NULL),
allg AS (SELECT _id, scheme, seq, tag AS grp, 'tag' AS kind FROM kt UNION ALL SELECT x._id, x.scheme, x.seq, x.tag || '+' || y.tag, 'tag_pair' FROM kt x JOIN kt y ON x._id = y._id AND x.scheme = y.scheme AND x.seq = y.seq AND x.tag < y.tag
 UNION ALL SELECT _id, scheme, seq, h, 'halfcent' FROM kh UNION ALL SELECT _id, scheme, seq, h || '|' || tag, 'halfcent_tag' FROM kh JOIN kt USING (_id, scheme, seq)),
gs AS (SELECT kind, grp FROM allg GROUP BY ALL HAVING count(*) >= 30),
grps AS (SELECT allg.* FROM allg JOIN gs USING (kind, grp)),
shared AS (SELECT DISTINCT _id, scheme, seq FROM feats INTERSECT SELECT DISTINCT _id, scheme, seq FROM grps),
f AS (SELECT feats.* FROM feats JOIN shared USING (_id, scheme, seq)), g AS (SELECT grps.* FROM grps JOIN shared USING (_id, scheme, seq)),
nf AS (SELECT feature, count(*) AS nf FROM f GROUP BY ALL HAVING count(*) >= 20), ng AS (SELECT grp, kind, count(*) AS ng FROM g GROUP BY ALL HAVING count(*) >= 30),
ab AS (SELECT grp, kind, feature, count(*) AS a FROM f JOIN g USING (_id, scheme, seq) GROUP BY ALL),
tab AS (SELECT grp, kind, feature, coalesce(a, 0) AS a, ng - coalesce(a, 0) AS b, nf - coalesce(a, 0) AS c, (SELECT count(*) FROM shared) - ng - nf + coalesce(a, 0) AS d
 FROM ng CROSS JOIN nf LEFT JOIN ab USING (grp, kind, feature))
"""
_FISHER = """
logs AS (SELECT *, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) AS k FROM {tab} WHERE NOT (b = 0 AND c = 0)),
steps AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM logs),
probs AS (SELECT * EXCLUDE (x), k - lgamma(x+1) - lgamma(a+b-x+1) - lgamma(a+c-x+1) - lgamma(d-a+x+1) AS lp, k - lgamma(a+1) - lgamma(b+1) - lgamma(c+1) - lgamma(d+1) AS lo FROM steps),
pv AS (SELECT * EXCLUDE (lp, lo, k), least(1.0, sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp) ELSE 0 END)) AS p_value FROM probs GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, {ties}) AS r, count(*) OVER () AS m FROM pv),
qv AS (SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM rk)
"""


def features_bool(s, d, p=None):
    content, place = features(s, d, p)
    return content.unionByName(place)


def joint_features(s, d):
    return T.joint_features(list(features(s, d)), KEY)


JOINT = f"WITH {_BASE}, both_ AS (SELECT _id, scheme, seq FROM content INTERSECT SELECT _id, scheme, seq FROM place) SELECT feats.* FROM feats JOIN both_ USING (_id, scheme, seq)"


def mixed_features(s, d):
    n = read(s, d, "new_characters")
    return T.expand_mixed(n, ["name_id"], {"gender": "enum", "social_class": "enum"}, {"social_class": {"criminal": 0, "servant": 1, "trade": 2, "clergy": 3, "gentry": 4, "nobility": 5}}, "who.")


MIXED = """SELECT name_id, 'who.gender__' || gender AS feature, 1.0::DOUBLE AS value FROM new_characters WHERE coalesce(gender, '') <> ''
UNION ALL SELECT name_id, 'who.social_class', CASE social_class WHEN 'criminal' THEN 0 WHEN 'servant' THEN 1 WHEN 'trade' THEN 2 WHEN 'clergy' THEN 3 WHEN 'gentry' THEN 4 WHEN 'nobility' THEN 5 ELSE -1 END FROM new_characters"""


def genre_extras(s, d):
    g = read(s, d, "genre_lite").select("_id", F.explode("genre_tags").alias("tag"))
    return T.extras(g, "_id", "tag", ["novel", "tale", "romance", "sea story"])


EXTRAS = """SELECT _id, """ + ", ".join(f"max(CAST(tag IS NOT DISTINCT FROM '{t}' AS INT)) AS genre_{t.replace(' ', '_')}" for t in ("novel", "tale", "romance", "sea story")) + """
FROM (SELECT _id, unnest(genre_tags) AS tag FROM genre_lite) GROUP BY _id"""


def group_members(s, d):
    return members(s, d)


def contingency_counts(s, d):
    p = passages(s, d)
    return T.contingency(features_bool(s, d, p), members(s, d, p=p), KEY)


def odds_rates(s, d):
    out = T.odds_and_rates(contingency_counts(s, d))
    return out.select("grp", "kind", "feature", F.when(F.col("odds") == float("inf"), -1.0).otherwise(F.round("odds", 6)).alias("odds"), F.round("rate_in", 8).alias("rate_in"), F.round("rate_out", 8).alias("rate_out"))


ODDS = f"""WITH {_BASE} SELECT grp, kind, feature, CASE WHEN b * c = 0 THEN -1.0 ELSE round(a::DOUBLE * d / (b * c), 6) END AS odds, round(a / (a + b)::DOUBLE, 8) AS rate_in, round(c / nullif(c + d, 0)::DOUBLE, 8) AS rate_out FROM tab WHERE NOT (b = 0 AND c = 0)"""


def discriminate(s, d):
    p = passages(s, d)
    out = T.discriminate(features_bool(s, d, p), members(s, d, p=p), KEY)
    return out.select("grp", "kind", "feature", "a", "b", "c", "d", F.round("p_value", 7).alias("p_value"), F.round("q_value", 7).alias("q_value"))


DISCRIMINATE = f"WITH {_BASE}, {_FISHER.format(tab='tab', ties='kind, grp, feature')} SELECT grp, kind, feature, a, b, c, d, round(p_value, 7) AS p_value, round(q_value, 7) AS q_value FROM qv"


def discriminate_report(s, d):
    p = passages(s, d)
    out = T.report(T.discriminate(features_bool(s, d, p), members(s, d, p=p), KEY), "kind", 1.1, 5, ["grp", "feature"])
    return out.select("kind", "rank", "grp", "feature", F.round("q_value", 7).alias("q_value"))


REPORT = f"WITH {_BASE}, {_FISHER.format(tab='tab', ties='kind, grp, feature')} SELECT kind, rank, grp, feature, round(q_value, 7) AS q_value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY q_value, p_value, grp, feature) AS rank FROM qv WHERE q_value < 1.1) WHERE rank <= 5"


def feature_pair_tests(s, d):
    f = features_bool(s, d)
    t = T.feature_pairs(f, KEY).filter("NOT (b = 0 AND c = 0)")
    out = T.benjamini_hochberg(Workspace(s, "tests").keep(T.fisher(t)), "p_value")
    return out.select("feature_a", "feature_b", "a", "b", "c", "d", F.round("p_value", 7).alias("p_value"), F.round("q_value", 7).alias("q_value"))


PAIRS = f"""WITH {_BASE}, n1 AS (SELECT feature, count(*) AS n FROM feats GROUP BY 1 HAVING count(*) >= 20), nn AS (SELECT count(*) AS n FROM (SELECT DISTINCT _id, scheme, seq FROM feats)),
ab2 AS (SELECT x.feature AS feature_a, y.feature AS feature_b, count(*) AS a FROM feats x JOIN feats y ON x._id = y._id AND x.scheme = y.scheme AND x.seq = y.seq AND x.feature < y.feature GROUP BY ALL),
ptab AS (SELECT x.feature AS feature_a, y.feature AS feature_b, coalesce(a, 0) AS a, x.n - coalesce(a, 0) AS b, y.n - coalesce(a, 0) AS c, nn.n - x.n - y.n + coalesce(a, 0) AS d
 FROM n1 x JOIN n1 y ON x.feature < y.feature AND split_part(x.feature, '.', 1) <> split_part(y.feature, '.', 1) CROSS JOIN nn LEFT JOIN ab2 ON ab2.feature_a = x.feature AND ab2.feature_b = y.feature),
{_FISHER.format(tab='ptab', ties='feature_a, feature_b')} SELECT feature_a, feature_b, a, b, c, d, round(p_value, 7) AS p_value, round(q_value, 7) AS q_value FROM qv"""


def coverage(s, d):
    b = T.coverage(read(s, d, "bibliography_entries"), ["author", "title", "title_sub", "year", "edition", "printer", "publisher", "bookseller"])
    return b.select("field", "n", "filled", F.round("share", 9).alias("share"))


COVERAGE = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) FILTER (coalesce({c}::VARCHAR, '') <> '') AS filled, round(count(*) FILTER (coalesce({c}::VARCHAR, '') <> '') / count(*)::DOUBLE, 9) AS share FROM bibliography_entries" for c in ("author", "title", "title_sub", "year", "edition", "printer", "publisher", "bookseller"))


def value_counts(s, d):
    return T.value_counts(read(s, d, "texts").filter("genre IS NOT NULL"), "genre", 3)


VALUE_COUNTS = "SELECT genre, count(*) AS n FROM texts WHERE genre IS NOT NULL GROUP BY 1 ORDER BY n DESC, genre LIMIT 3"


def presence_rates(s, d):
    j = passages(s, d).join(read(s, d, "texts").select("_id", "lang"), "_id").filter("lang IN ('en', 'fr', 'de')")
    out = T.presence_rates(j, "lang", "scene_content", ["en", "fr", "de"], 12)
    return out.select("item", *[F.round(c, 9).alias(c) for c in ("rate_en", "rate_fr", "rate_de", "spread")])


PRESENCE = f"""WITH {_BASE}, j AS (SELECT _id, scheme, seq, lang FROM flag JOIN texts USING (_id) WHERE lang IN ('en', 'fr', 'de')), tot AS (SELECT lang, count(*) AS total FROM j GROUP BY 1),
r AS (SELECT x AS item, lang, count(*) / any_value(total)::DOUBLE AS rate FROM sc JOIN j USING (_id, scheme, seq) JOIN tot USING (lang) GROUP BY ALL),
w AS (SELECT item, coalesce(max(rate) FILTER (lang = 'en'), 0) AS rate_en, coalesce(max(rate) FILTER (lang = 'fr'), 0) AS rate_fr, coalesce(max(rate) FILTER (lang = 'de'), 0) AS rate_de FROM r GROUP BY 1),
z AS (SELECT *, greatest(rate_en, rate_fr, rate_de) - least(rate_en, rate_fr, rate_de) AS spread FROM w)
SELECT item, round(rate_en, 9) AS rate_en, round(rate_fr, 9) AS rate_fr, round(rate_de, 9) AS rate_de, round(spread, 9) AS spread FROM (SELECT * FROM z ORDER BY z.spread DESC, item LIMIT 12)"""


def rates_by_language(s, d):
    """Rates over the answers of all agents, with lists in every form; an agent's answers are left out where it says itself that the passage is no prose fiction."""
    # the passage as one agent saw it
    a = latest_votes(s, d).select("_id", F.concat_ws("\x01", "scheme", "agent").alias("scheme"), "seq", "field", "value")
    flag = a.filter("field = 'is_prose_fiction'").select("_id", "scheme", "seq", F.col("value").alias("flag"))
    spec = [X.parse_field_spec(x) for x in ("has_dialogue", ("introduces_new_character", "new"), ("scene_content::wooing", "wooing"))]
    return T.cross_language(a, read(s, d, "texts"), spec, [1600, 1700, 1800, 1900], flag)


RATES = f"""WITH {AGREEMENT_READ} p AS (SELECT _id, scheme, seq, agent, coalesce(min(CAST(value = 'true' AS INT)), 1) AS p FROM votes WHERE field = 'is_prose_fiction' GROUP BY ALL),
r AS (SELECT votes.*, CASE field WHEN 'has_dialogue' THEN 'has_dialogue' WHEN 'introduces_new_character' THEN 'new' ELSE 'wooing' END AS label,
 CASE WHEN field = 'scene_content' THEN coalesce(list_contains(from_json(value, '["VARCHAR"]'), 'wooing'), false) ELSE coalesce(value = 'true', false) END AS hit
 FROM votes LEFT JOIN p USING (_id, scheme, seq, agent) WHERE field IN ('has_dialogue', 'introduces_new_character', 'scene_content') AND coalesce(p, 1) = 1)
SELECT lang, label, period, count(*) AS n, count(*) FILTER (hit) AS n_true, round_even(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 1) AS pct
FROM r JOIN (SELECT _id, lang, CASE WHEN year >= 1600 AND year < 1700 THEN '1600-1699' WHEN year >= 1700 AND year < 1800 THEN '1700-1799' WHEN year >= 1800 AND year < 1900 THEN '1800-1899' END AS period FROM texts) USING (_id)
WHERE period IS NOT NULL AND lang IS NOT NULL GROUP BY ALL"""


def gini_lengths(s, d):
    out = T.gini(read(s, d, "documents").filter("source IS NOT NULL AND n_chars IS NOT NULL"), ["source"], "n_chars")
    return out.select("source", F.round("gini", 7).alias("gini"))


GINI = """SELECT source, round(CASE WHEN count(*) < 2 OR sum(n_chars) = 0 THEN 0 ELSE 2 * sum(r * n_chars)::DOUBLE / (count(*) * nullif(sum(n_chars), 0)) - (count(*) + 1) / count(*)::DOUBLE END, 7) AS gini
FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL) GROUP BY source"""


def residuals(s, d):
    o = read(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent")).join(read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return T.residualize(o, ["c_nationkey"], "n", ["spent"]).select("o_custkey", F.round("spent_resid", 1).alias("spent_resid"))


RESIDUALS = """SELECT o_custkey, round(CASE WHEN count(*) OVER w >= 5 THEN spent - (regr_intercept(spent, ln(1 + n)) OVER w + regr_slope(spent, ln(1 + n)) OVER w * ln(1 + n)) END, 1) AS spent_resid
FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY c_nationkey)"""


def size_correlation(s, d):
    t = read(s, d, "relations").groupBy("_id").agg(F.count(F.lit(1)).alias("n_rel")).join(read(s, d, "new_characters").groupBy("_id").agg(F.count(F.lit(1)).alias("n_chars")), "_id")
    return t.agg(F.round(F.corr(F.log1p("n_chars"), F.col("n_rel").cast("double")), 8).alias("r"), F.count(F.lit(1)).alias("n"))


CORR = "SELECT round(corr(ln(1 + n_chars), n_rel), 8) AS r, count(*) AS n FROM (SELECT _id, count(*) AS n_rel FROM relations GROUP BY 1) JOIN (SELECT _id, count(*) AS n_chars FROM new_characters GROUP BY 1) USING (_id)"


def r2_partition(s, d):
    e = read(s, d, "embeddings").select("vec_id", "label", "embedding")
    cols = {f"l{k}": (F.col("label") == k).cast("double") for k in range(9)} | {"parity": F.pmod("vec_id", F.lit(2)).cast("double"), "third": F.pmod("vec_id", F.lit(3)).cast("double")}
    return T.partition_r2(e.withColumns(cols), "embedding", {"label": [f"l{k}" for k in range(9)], "order": ["parity", "third"]})


QUERIES = {"features_bool": features_bool, "joint_features": joint_features, "mixed_features": mixed_features, "genre_extras": genre_extras, "group_members": group_members, "contingency_counts": contingency_counts, "odds_rates": odds_rates, "discriminate_fisher_bh": discriminate, "discriminate_report": discriminate_report, "feature_pair_tests": feature_pair_tests, "coverage": coverage, "value_counts": value_counts, "presence_rate_spread": presence_rates, "rates_by_lang_period": rates_by_language, "gini": gini_lengths, "residualize_ols": residuals, "corr_size": size_correlation, "r2_partition": r2_partition}
ORACLES = {"features_bool": f"WITH {_BASE} SELECT * FROM feats", "joint_features": JOINT, "mixed_features": MIXED, "genre_extras": EXTRAS, "group_members": f"WITH {_BASE} SELECT _id, scheme, seq, grp, kind FROM grps", "contingency_counts": f"WITH {_BASE} SELECT * FROM tab", "odds_rates": ODDS, "discriminate_fisher_bh": DISCRIMINATE, "discriminate_report": REPORT, "feature_pair_tests": PAIRS, "coverage": COVERAGE, "value_counts": VALUE_COUNTS, "presence_rate_spread": PRESENCE, "rates_by_lang_period": RATES, "gini": GINI, "residualize_ols": RESIDUALS, "corr_size": CORR}
