"""Texts into passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import segment as S
from folioscope.runtime import read

_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"


def fixed_windows(s, d):
    return S.fixed_windows(read(s, d, "documents"), "doc_id", "text", 100)


FIXED = f"""SELECT doc_id, i AS seq, array_to_string(list_slice(w, i*100+1, i*100+100), ' ') AS text, len(list_slice(w, i*100+1, i*100+100)) AS n_words
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w)/100.0) AS BIGINT))) AS i FROM (SELECT doc_id, {_W} AS w FROM documents))"""


def sampled_even(s, d):
    return S.sampled_windows(read(s, d, "documents"), "doc_id", "text", 80, 4, "even").drop("text")


SAMPLED = f"""SELECT doc_id, printf('W%04d', i + 1) AS section_id, (i + 1) || '/' || CASE WHEN n < 80 THEN 1 ELSE 4 END AS passage_index, start, len(list_slice(w, start + 1, start + 80)) AS n_words
FROM (SELECT *, CASE WHEN n < 80 THEN 0 ELSE CAST(floor(i * (n - 80) / 3.0) AS BIGINT) END AS start FROM (SELECT *, unnest(range(0, CASE WHEN n < 80 THEN 1 ELSE 4 END)) AS i
FROM (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_W} AS w FROM documents)) WHERE n > 0))"""


def sampled_stratified(s, d):
    return S.sampled_windows(read(s, d, "documents"), "doc_id", "text", 80, 2, "stratified").drop("text")


STRATIFIED = f"""SELECT doc_id, printf('W%04d', i + 1) AS section_id, (i + 1) || '/' || CASE WHEN n < 80 THEN 1 ELSE 2 END AS passage_index, CASE WHEN n < 80 OR i = 0 THEN 0 ELSE n - 80 END AS start,
 least(80, n) AS n_words FROM (SELECT *, unnest(range(0, CASE WHEN n < 80 THEN 1 ELSE 2 END)) AS i FROM (SELECT doc_id, len({_W}) AS n FROM documents) WHERE n > 0)"""


def head_mid_tail(s, d):
    return S.head_mid_tail(read(s, d, "documents"), "doc_id", "text", 60, 30, 60)


HEAD = f"""SELECT doc_id, CASE WHEN n < 90 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:60], ' ') END AS opening,
 CASE WHEN n < 90 THEN '' ELSE array_to_string(list_slice(w, greatest(60, n // 2 - 15) + 1, greatest(60, n // 2 - 15) + 30), ' ') END AS middle,
 CASE WHEN n < 90 THEN '' ELSE array_to_string(list_slice(w, n - 59, n), ' ') END AS closing FROM (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_W} AS w FROM documents))"""


def _sections(s, d):
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n"))
    return read(s, d, "documents").select("doc_id", parts.alias("o", "x")).withColumn("t", F.concat(F.lit("Chapter "), F.col("o").cast("string")))


def chapter_prompts(s, d):
    """Paragraphs as sections, joined and split to chapters of 60 to 120 words; at most 5 per text."""
    return S.chapters(_sections(s, d), "doc_id", "o", "t", "x", 60, 120, 5)


def even_sample(s, d):
    p = read(s, d, "passage_content").select("_id", "scheme", "seq").distinct()
    return S.even_sample(p, "_id", ["scheme", "seq"], 3)


EVEN = """SELECT _id, scheme, seq FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY scheme, seq) - 1 AS i, count(*) OVER (PARTITION BY _id) AS n FROM (SELECT DISTINCT _id, scheme, seq FROM passage_content))
WHERE n <= 3 OR i IN (0, (n - 1) // 2, n - 1)"""


def stratified_sample(s, d):
    return S.stratified_sample(read(s, d, "texts").filter("genre IS NOT NULL"), "genre", ["_id"], 60, 4, "7").select("_id", "genre")


STRAT = "SELECT _id, genre FROM (SELECT _id, genre, row_number() OVER (PARTITION BY genre ORDER BY md5('7|' || _id), _id) AS r FROM texts WHERE genre IS NOT NULL) WHERE r <= 15"


def html_chunks(s, d):
    """Documents marked up as pages: a heading for every source, a paragraph for every blank line."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\n\n", "</p><p>")
    page = read(s, d, "documents").select("doc_id", F.concat(F.lit("<i>top</i><h2>"), "source", F.lit("</h2><p>"), body, F.lit("</p><h2>end</h2>")).alias("html"))
    return S.html_chunks(page, "doc_id", "html", most=2)


HTML = r"""WITH p AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10) || chr(10)) AS w FROM documents),
i AS (SELECT doc_id, source, len(w) AS n, list_transform(w, lambda x: '<p>' || x || '</p>') AS w FROM p)
SELECT doc_id, 0 AS section, 0 AS chunk, '' AS heading, '<i>top</i>' AS text FROM p
UNION ALL SELECT doc_id, 1, c, '<h2>' || source || '</h2>', '<h2>' || source || '</h2>' || array_to_string(list_slice(w, c*2+1, c*2+2), '')
 FROM (SELECT *, unnest(range(0, (n + 1) // 2)) AS c FROM i)
UNION ALL SELECT doc_id, 2, 0, '<h2>end</h2>', '<h2>end</h2>' FROM p"""


def passage_prompts(s, d):
    p = S.fixed_windows(read(s, d, "documents").filter("_id IS NOT NULL").select("doc_id", "_id", "text").withColumn("k", F.struct("doc_id", "_id")), "k", "text", 100)
    t = read(s, d, "texts")
    j = p.select("k.doc_id", "k._id", "seq", "text", "n_words").join(t.select("_id", "title", "author", F.col("year").alias("y")), "_id")
    return j.select("doc_id", "seq", S.passage_prompt(F.col("text"), F.col("title"), F.col("author"), F.col("y"), F.col("seq")).alias("prompt"))


PROMPTS = f"""SELECT doc_id, seq, concat_ws(chr(10), CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title END, CASE WHEN trim(split_part(coalesce(author, ''), ',', 1)) <> '' THEN 'Author: ' || trim(split_part(author, ',', 1)) END,
 CASE WHEN year IS NOT NULL THEN 'Year: ' || year END, 'Passage: ' || seq) || chr(10) || chr(10) || 'PASSAGE:' || chr(10) || p.text AS prompt
FROM (SELECT doc_id, _id, i AS seq, array_to_string(list_slice(w, i*100+1, i*100+100), ' ') AS text FROM (SELECT doc_id, _id, w, unnest(range(0, CAST(ceil(len(w)/100.0) AS BIGINT))) AS i
 FROM (SELECT doc_id, _id, {_W} AS w FROM documents WHERE _id IS NOT NULL))) p JOIN texts USING (_id)"""


def chunk_prompts(s, d):
    return S.chunk_prompts(S.fixed_windows(read(s, d, "documents"), "doc_id", "text", 50), "doc_id", "seq", "text", "n_words", 4)


CHUNKS = f"""SELECT doc_id, seq // 4 AS chunk, min(seq) AS first, max(seq) AS last, string_agg(printf('--- P%03d (%d words) ---', seq, n_words) || chr(10) || text, chr(10) || chr(10) ORDER BY seq) AS prompt
FROM (SELECT doc_id, i AS seq, array_to_string(list_slice(w, i*50+1, i*50+50), ' ') AS text, len(list_slice(w, i*50+1, i*50+50)) AS n_words
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w)/50.0) AS BIGINT))) AS i FROM (SELECT doc_id, {_W} AS w FROM documents))) GROUP BY doc_id, seq // 4"""


def triples(s, d):
    lines = read(s, d, "relations").select("rel_id", F.concat(F.lit("note\n("), F.coalesce("a", F.lit("?")), F.lit(", "), F.coalesce("type", F.lit("?")), F.lit(", "), F.coalesce(F.nullif("b", F.lit("")), F.lit("?")), F.coalesce(F.concat(F.lit(", "), F.nullif("detail", F.lit(""))), F.lit("")), F.lit(")")).alias("out"))
    return S.parse_triples(lines, "rel_id", "out")


TRIPLES = "SELECT rel_id, 1 AS line, trim(coalesce(a, '?')) AS s, trim(coalesce(type, '?')) AS p, trim(coalesce(nullif(b, ''), '?')) AS o, nullif(trim(detail), '') AS ctx FROM relations"


def mention_windows(s, d):
    """Windows of ten words around capitalised words, as a document's mentions of each such word."""
    w = read(s, d, "documents").select("doc_id", F.posexplode(S.words(F.col("text"))).alias("token", "word"))
    m = w.filter(F.col("word").rlike(r"^\p{Lu}\p{Ll}{5,}$")).select("doc_id", F.col("word").alias("entity"), F.col("token").alias("start"), F.lit(0).alias("rank"))
    return S.mention_windows(w, m, "doc_id", "token", "word", "entity", "start", 10, 3)


def word_descriptors(s, d):
    w = read(s, d, "documents").filter("source IS NOT NULL").select("source", F.coalesce("form", F.lit("none")).alias("form"), F.explode(S.words(F.lower("text"))).alias("word"))
    return S.descriptors(w, ["source"], "form", "word", 3)


DESCRIPTORS = r"""SELECT source, form, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, form ORDER BY n DESC, word) AS rank FROM (
 SELECT source, form, word, count(*) AS n FROM (SELECT source, coalesce(form, 'none') AS form, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM documents WHERE source IS NOT NULL) GROUP BY ALL)) WHERE rank <= 3"""


def roster(s, d):
    c = read(s, d, "relations").groupBy("_id", F.regexp_extract("a", r"^C0*(\d+)$", 1).try_cast("bigint").alias("ent")).agg(F.count(F.lit(1)).alias("n")).filter("ent IS NOT NULL")
    return S.roster(c.withColumn("name", F.format_string("C%02d", "ent")), "_id", "ent", "name", "n", 3, 5)


ROSTER = r"""SELECT _id, ent, rank, printf('C%02d (%d mentions)', ent, n) AS line FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY n DESC, ent) AS rank FROM (
 SELECT _id, TRY_CAST(regexp_extract(a, '^C0*(\d+)$', 1) AS BIGINT) AS ent, count(*) AS n FROM relations GROUP BY ALL) WHERE ent IS NOT NULL AND n >= 3 AND ent <> 0) WHERE rank <= 5"""

QUERIES = {"fixed_windows": fixed_windows, "sampled_windows_even": sampled_even, "sampled_windows_stratified": sampled_stratified, "head_mid_tail": head_mid_tail, "chapter_prompts": chapter_prompts, "even_sample": even_sample, "stratified_sample": stratified_sample, "html_chunks": html_chunks, "passage_prompts": passage_prompts, "chunk_prompts": chunk_prompts, "parse_triples": triples, "mention_windows": mention_windows, "word_descriptors": word_descriptors, "roster": roster}
ORACLES = {"fixed_windows": FIXED, "sampled_windows_even": SAMPLED, "sampled_windows_stratified": STRATIFIED, "head_mid_tail": HEAD, "even_sample": EVEN, "stratified_sample": STRAT, "html_chunks": HTML, "passage_prompts": PROMPTS, "chunk_prompts": CHUNKS, "parse_triples": TRIPLES, "word_descriptors": DESCRIPTORS, "roster": ROSTER}
