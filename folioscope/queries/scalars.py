"""Scalar expressions, each row of a table once."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.runtime import read

BREAKS = [1600, 1650, 1700, 1750, 1800, 1850]


def text_years(s, d):
    t = read(s, d, "texts")
    y = F.col("year")
    return t.select("_id", X.half_century(y).alias("half_century"), X.century_range(y).alias("century"), X.period_bin(y, BREAKS).alias("period"), X.sane_year(y).cast("string").alias("sane_year"), X.json_text(F.col("meta"), "shelf").alias("shelf"), X.json_text(F.col("meta"), "year_orig").alias("year_orig"))


TEXT_YEARS = """SELECT _id, CAST(floor(year / 50.0) * 50 AS BIGINT) || '-' || CAST(floor(year / 50.0) * 50 + 49 AS BIGINT) AS half_century,
 CAST(floor(year / 100.0) * 100 AS BIGINT) || '-' || CAST(floor(year / 100.0) * 100 + 100 AS BIGINT) AS century,
 CASE WHEN year >= 1600 AND year < 1650 THEN '1600-1649' WHEN year >= 1650 AND year < 1700 THEN '1650-1699' WHEN year >= 1700 AND year < 1750 THEN '1700-1749'
 WHEN year >= 1750 AND year < 1800 THEN '1750-1799' WHEN year >= 1800 AND year < 1850 THEN '1800-1849' END AS period,
 CASE WHEN year BETWEEN -500 AND 2100 THEN year::VARCHAR END AS sane_year, coalesce(meta::JSON ->> '$.shelf', '') AS shelf, coalesce(meta::JSON ->> '$.year_orig', '') AS year_orig FROM texts"""


def period_dummies(s, d):
    t = read(s, d, "texts").withColumns(X.period_dummies(F.col("year"), BREAKS))
    return t.select("_id", *[f"period_{a}_{b - 1}" for a, b in zip(BREAKS, BREAKS[1:])])


PERIOD_DUMMIES = "SELECT _id, " + ", ".join(f"coalesce(CAST(year >= {a} AND year < {b} AS INT), 0) AS period_{a}_{b - 1}" for a, b in zip(BREAKS, BREAKS[1:])) + " FROM texts"


def text_names(s, d):
    t = read(s, d, "texts")
    return t.select(
        "_id", X.last_name(F.col("author")).alias("last_name"), X.path_slug(F.col("_id")).alias("slug"), X.slug_to_id(F.concat(F.lit("quarto_"), F.substring_index("_id", "/", -1))).alias("from_slug"),
        X.first_text(F.col("author"), F.col("title")).alias("label"), X.item_key(F.col("_id"), F.lit("p500:1"), F.col("title")).alias("item_key"),
        X.is_paratext(F.col("title")).alias("paratext"), X.keep_last_words(F.col("title"), 3).alias("tail"),
    )


TEXT_NAMES = r"""SELECT _id, trim(split_part(author, ',', 1)) AS last_name, regexp_replace(regexp_replace(lower(_id), '^_', ''), '[/\s]+', '_', 'g') AS slug,
 '_quarto/' || split_part(_id, '/', -1) AS from_slug, coalesce(nullif(author, ''), nullif(title, ''), '') AS label, _id || '::p500:1' AS item_key,
 regexp_matches(lower(coalesce(title, '')), 'title page|table of contents|contents|errata|advertisement|subscribers|index') AS paratext,
 CASE WHEN len(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> '')) <= 3 THEN title
  ELSE '... ' || array_to_string(list_slice(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> ''), -3, -1), ' ') END AS tail FROM texts"""


def full_titles(s, d):
    b = read(s, d, "bibliography_entries")
    return b.select("name_id", X.full_title(F.col("title"), F.col("title_sub")).alias("full_title"))


FULL_TITLES = r"""SELECT name_id, CASE WHEN s = '' THEN m WHEN m = '' THEN s WHEN regexp_matches(m, '[:;.?!,]$') THEN m || ' ' || s ELSE m || ': ' || s END AS full_title
 FROM (SELECT name_id, coalesce(title, '') AS m, trim(regexp_replace(coalesce(title_sub, ''), '^[\s:;,]+', '')) AS s FROM bibliography_entries)"""


def name_classes(s, d):
    known = F.array(*[F.lit(x) for x in ("john", "mary", "thomas", "sarah", "william", "elizabeth")])
    n = read(s, d, "new_characters")
    return n.select("name_id", X.classify_name(F.col("name"), known).alias("name_class"))


NAME_CLASSES = r"""SELECT name_id, CASE WHEN coalesce(name, '') = '' THEN 'unknown' WHEN regexp_matches(lower(name), '^(the |a |an )') OR regexp_matches(name, '^[A-Z][a-z]+''s ') THEN 'type'
 WHEN list_has_any(list_transform(regexp_split_to_array(lower(name), '\s+'), lambda w: regexp_replace(w, '^[.,]+|[.,]+$', '', 'g')), ['john', 'mary', 'thomas', 'sarah', 'william', 'elizabeth']) THEN 'realistic'
 WHEN regexp_matches(lower(split_part(trim(name), ' ', 1)), '(us|ia|issa|andra|ander|enes|oles|inda|etta|ina)$') THEN 'classical' ELSE 'other' END AS name_class FROM new_characters"""


def named_characters(s, d):
    r = read(s, d, "character_resolutions")
    return r.filter(X.is_named(F.col("type"), F.col("name"))).select("name_id", "_id", "name")


NAMED = r"""SELECT name_id, _id, name FROM character_resolutions WHERE type = 'character' AND regexp_matches(name, '^\p{Lu}')
 AND NOT regexp_matches(lower(name), '^(the |a |an |his |her |my |our |their |some |one |two |old |young |another )')"""


def stored_values(s, d):
    a = read(s, d, "passage_annotations").filter(F.col("task") == "passage-content")
    section = F.concat(F.col("scheme"), F.lit(":"), F.col("seq"))
    v = F.col("value")
    return a.select(
        "_id", "seq", "field", F.unix_micros("annotated_at").alias("at"), "source_agent", X.section_scheme(section).alias("p_scheme"), X.section_seq(section).alias("p_seq"), X.norm_bool(v).cast("string").alias("as_bool"), X.truthy(v).alias("truthy"),
        F.array_join(F.when(v.rlike(r'^\["[^\']*"\]$'), X.norm_list(v)).otherwise(F.array().cast("array<string>")), "|").alias("labels"), F.when(v.rlike(r'^\["[^\']*"\]$'), X.list_contains(v, "wooing")).otherwise(False).alias("has_wooing"),
        X.source_label(F.col("source_family"), F.col("source_agent"), F.col("task"), F.col("task_version")).alias("source"), X.serialize(v, "str").alias("stored"),
    )


STORED = r"""SELECT _id, seq, field, epoch_us(annotated_at) AS at, source_agent, scheme AS p_scheme, seq AS p_seq,
 CASE WHEN lower(trim(value)) IN ('true', '1') THEN 'true' WHEN lower(trim(value)) IN ('false', '0', '') THEN 'false' END AS as_bool,
 coalesce(lower(value) IN ('true', '1', 'yes'), false) AS truthy,
 CASE WHEN regexp_full_match(value, '\["[^'']*"\]') THEN array_to_string(list_sort(from_json(value, '["VARCHAR"]')), '|') ELSE '' END AS labels,
 CASE WHEN regexp_full_match(value, '\["[^'']*"\]') THEN list_contains(from_json(value, '["VARCHAR"]'), 'wooing') ELSE false END AS has_wooing,
 source_family || ':' || source_agent || ':' || task || ':v' || task_version AS source, coalesce(value, '') AS stored
 FROM passage_annotations WHERE task = 'passage-content'"""


def ordinals(s, d):
    t = read(s, d, "new_characters")
    return t.select("name_id", X.ordinal(F.col("social_class"), {"criminal": 0, "servant": 1, "trade": 2, "clergy": 3, "gentry": 4, "nobility": 5}).alias("rank"))


ORDINALS = "SELECT name_id, CASE social_class WHEN 'criminal' THEN 0 WHEN 'servant' THEN 1 WHEN 'trade' THEN 2 WHEN 'clergy' THEN 3 WHEN 'gentry' THEN 4 WHEN 'nobility' THEN 5 ELSE -1 END AS rank FROM new_characters"


def model_names(s, d):
    a = read(s, d, "passage_annotations").select(F.concat(F.lit("local/Org/"), F.upper("source_agent"), F.lit("-v2.5")).alias("model")).distinct()
    return a.select("model", X.model_slug(F.col("model")).alias("slug"), X.provider_route(F.col("model")).alias("route"), X.strip_route(F.col("model")).alias("bare"))


MODELS = r"""SELECT DISTINCT m AS model, replace(replace(lower(split_part(m, '/', -1)), '.', ''), ':', '') AS slug, 'local' AS route, regexp_replace(m, '^local/', '') AS bare
 FROM (SELECT 'local/Org/' || upper(source_agent) || '-v2.5' AS m FROM passage_annotations)"""

QUERIES = {"text_years": text_years, "period_dummies": period_dummies, "text_names": text_names, "full_titles": full_titles, "name_classes": name_classes, "named_characters": named_characters, "stored_values": stored_values, "ordinal_encode": ordinals, "model_names": model_names}
ORACLES = {"text_years": TEXT_YEARS, "period_dummies": PERIOD_DUMMIES, "text_names": TEXT_NAMES, "full_titles": FULL_TITLES, "name_classes": NAME_CLASSES, "named_characters": NAMED, "stored_values": STORED, "ordinal_encode": ORDINALS, "model_names": MODELS}
