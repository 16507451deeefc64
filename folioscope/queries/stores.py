"""The annotation store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import segment as S
from folioscope.operators import store as A
from folioscope.runtime import read

FIELDS = ["has_dialogue", "introduces_new_character", "is_prose_fiction", "narration_mode", "scene_content"]


def _facts(s, d):
    return read(s, d, "passage_annotations")


def store_scan(s, d):
    return A.scan(_facts(s, d), fields=["has_dialogue", "narration_mode"], agent="hollin-70b", task="passage-content", version=2).select("_id", "scheme", "seq", "field", "value", F.unix_micros("annotated_at").alias("at"))


SCAN = "SELECT _id, scheme, seq, field, value, epoch_us(annotated_at) AS at FROM passage_annotations WHERE field IN ('has_dialogue', 'narration_mode') AND source_agent = 'hollin-70b' AND task = 'passage-content' AND task_version = 2"


def latest_view(s, d):
    return A.latest(_facts(s, d)).drop("meta").withColumn("latest_at", F.unix_micros("latest_at"))


_NEW = "annotated_at, coalesce(run_id, ''), coalesce(value, '')"
LATEST = f"""SELECT _id, scheme, seq, field, source_family, source_agent, task, task_version, arg_max(struct_pack(v := value), ({_NEW})).v AS value, epoch_us(max(annotated_at)) AS latest_at,
 source_family || ':' || source_agent || ':' || task || ':v' || task_version AS source FROM passage_annotations GROUP BY _id, scheme, seq, field, source_family, source_agent, task, task_version"""


def latest_by_source(s, d):
    return A.latest(_facts(s, d), ["_id", "source_agent"]).select("_id", "source_agent", F.unix_micros("latest_at").alias("latest_at"))


BY_SOURCE = "SELECT _id, source_agent, epoch_us(max(annotated_at)) AS latest_at FROM passage_annotations GROUP BY ALL"


def newest_version(s, d):
    return A.newest_version(_facts(s, d)).groupBy("task", "task_version").agg(F.count(F.lit(1)).alias("n"))


NEWEST = "SELECT task, task_version, count(*) AS n FROM passage_annotations SEMI JOIN (SELECT task, max(task_version) AS task_version FROM passage_annotations GROUP BY 1) USING (task, task_version) GROUP BY ALL"


def pivot_wide(s, d):
    v = A.latest(A.scan(_facts(s, d), agent="hollin-70b", task="passage-content", version=2))
    wide = A.pivot(v, ["_id", "scheme", "seq"], FIELDS, ["has_dialogue", "is_prose_fiction"])
    return wide.withColumns({c: F.col(c).cast("string") for c in ("has_dialogue", "is_prose_fiction")})


PIVOT = f"""WITH v AS (SELECT _id, scheme, seq, field, arg_max(struct_pack(v := value), ({_NEW})).v AS value FROM passage_annotations WHERE source_agent = 'hollin-70b' AND task = 'passage-content' AND task_version = 2 GROUP BY _id, scheme, seq, field)
SELECT _id, scheme, seq, """ + ", ".join(f"max(value) FILTER (field = '{f}'" + (" AND value IN ('true', 'false')" if f in ("has_dialogue", "is_prose_fiction") else "") + f") AS {f}" for f in FIELDS) + " FROM v GROUP BY ALL"


def boolean_fields(s, d):
    return A.boolean_fields(_facts(s, d).filter("task = 'passage-form'").withColumn("value", F.when(F.lower(F.trim("value")).isin("true", "false"), F.lower(F.trim("value"))).otherwise(F.when(F.col("field") != "is_framed", F.col("value")))))


BOOLEANS = """SELECT field FROM (SELECT field, CASE WHEN lower(trim(value)) IN ('true', 'false') THEN lower(trim(value)) WHEN field <> 'is_framed' THEN value END AS v FROM passage_annotations WHERE task = 'passage-form')
GROUP BY 1 HAVING count(*) FILTER (v IS NOT NULL AND v NOT IN ('true', 'false')) = 0 AND count(v) > 0"""


def dedupe_last(s, d):
    e = read(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return A.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


DEDUPE = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


def write_facts(s, d):
    p = read(s, d, "passage_content").select("_id", "scheme", "seq", "scene_content", "is_prose_fiction", F.round("confidence", 4).alias("confidence"))
    one = A.keep_last(p.withColumn("o", F.lit(0)), ["_id", "scheme", "seq"], ["o"])
    out = A.to_facts(one, {"scene_content": "list", "is_prose_fiction": "bool"}, "llm", "wicket-8b", "passage-content", 3, "run1", F.timestamp_seconds(F.lit(1750000000)))
    return out.groupBy("field", "source_family", "source_agent", "task", "task_version", "run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == "[]").alias("empty"), F.count_if(F.col("value") == "true").alias("yes"))


WRITTEN = """WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id, scheme, seq ORDER BY scene_content DESC NULLS LAST, is_prose_fiction DESC NULLS LAST, round(confidence, 4) DESC NULLS LAST) AS r FROM passage_content) WHERE r = 1),
f AS (SELECT 'scene_content' AS field, count(*) FILTER (scene_content IS NOT NULL) AS n, count(*) FILTER (len(scene_content) = 0) AS empty, 0 AS yes FROM k UNION ALL SELECT 'is_prose_fiction', count(is_prose_fiction), 0, count(*) FILTER (is_prose_fiction) FROM k)
SELECT field, 'llm' AS source_family, 'wicket-8b' AS source_agent, 'passage-content' AS task, 3 AS task_version, 'run1' AS run_id, n, empty, yes FROM f WHERE n > 0"""


def pending(s, d):
    want = read(s, d, "passage_content").select("_id", "scheme", "seq").distinct()
    return A.pending(want, _facts(s, d).filter("task = 'passage-content'"), ["_id", "scheme", "seq"], "reader_3")


PENDING = "SELECT DISTINCT _id, scheme, seq FROM passage_content ANTI JOIN (SELECT * FROM passage_annotations WHERE task = 'passage-content' AND source_agent = 'reader_3') USING (_id, scheme, seq)"


def config_table(s, d):
    c = _facts(s, d).select(F.get_json_object("meta", "$.config_sha256").alias("config_sha256"), "task", "source_agent", "task_version", F.unix_micros("annotated_at").alias("first_seen")).filter("config_sha256 IS NOT NULL")
    return A.configs(c)


CONFIGS = """SELECT config_sha256, min(first_seen) AS first_seen, arg_min(task, (first_seen, task, source_agent, task_version)) AS task, arg_min(source_agent, (first_seen, task, source_agent, task_version)) AS source_agent,
 arg_min(task_version, (first_seen, task, source_agent, task_version)) AS task_version FROM (SELECT meta::JSON ->> '$.config_sha256' AS config_sha256, task, source_agent, task_version, epoch_us(annotated_at) AS first_seen FROM passage_annotations WHERE meta LIKE '{%')
WHERE config_sha256 IS NOT NULL GROUP BY 1"""


def reconstruct(s, d):
    """Prompts behind the annotated chapters, from the documents of the work, in their order, as passages."""
    place = F.row_number().over(Window.partitionBy("_id").orderBy("doc_id")) - 1
    docs = read(s, d, "documents").filter("_id IS NOT NULL AND text IS NOT NULL").select("_id", F.lit("chapter").alias("scheme"), place.cast("bigint").alias("seq"), "text")
    conf = A.configs(_facts(s, d).select(F.get_json_object("meta", "$.config_sha256").alias("config_sha256"), "task", F.col("annotated_at").alias("first_seen")).filter("config_sha256 IS NOT NULL"))
    prompt = F.concat(F.lit("["), F.col("task"), F.lit("] "), S.passage_prompt(F.col("text"), F.col("title"), F.col("author"), F.col("year"), F.col("seq")))
    texts = read(s, d, "texts").select("_id", "title", "author", "year")
    return A.reconstruct(_facts(s, d), docs, texts, conf, prompt).select("_id", "scheme", "seq", "config_sha256", F.md5("prompt").alias("prompt_md5"))


RECONSTRUCT = """WITH docs AS (SELECT _id, 'chapter' AS scheme, row_number() OVER (PARTITION BY _id ORDER BY doc_id) - 1 AS seq, text FROM documents WHERE _id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT config_sha256, arg_min(task, (first_seen, task)) AS task FROM (SELECT meta::JSON ->> '$.config_sha256' AS config_sha256, task, annotated_at AS first_seen FROM passage_annotations WHERE meta LIKE '{%') WHERE config_sha256 IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT _id, scheme, seq, meta::JSON ->> '$.config_sha256' AS config_sha256 FROM passage_annotations WHERE meta LIKE '{%')
SELECT a._id, a.scheme, a.seq, config_sha256, md5('[' || task || '] ' || concat_ws(chr(10), CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title END, CASE WHEN trim(split_part(coalesce(author, ''), ',', 1)) <> '' THEN 'Author: ' || trim(split_part(author, ',', 1)) END,
 CASE WHEN year IS NOT NULL THEN 'Year: ' || year END, 'Passage: ' || a.seq) || chr(10) || chr(10) || 'PASSAGE:' || chr(10) || docs.text) AS prompt_md5
FROM a JOIN docs USING (_id, scheme, seq) JOIN texts USING (_id) JOIN c USING (config_sha256)"""

QUERIES = {"store_scan": store_scan, "latest_view": latest_view, "latest_by_source": latest_by_source, "newest_version": newest_version, "pivot_wide": pivot_wide, "boolean_fields": boolean_fields, "dedupe_last": dedupe_last, "write_facts": write_facts, "pending_keys": pending, "config_table": config_table, "reconstruct_prompts": reconstruct}
ORACLES = {"write_facts": WRITTEN, "reconstruct_prompts": RECONSTRUCT, "store_scan": SCAN, "latest_view": LATEST, "latest_by_source": BY_SOURCE, "newest_version": NEWEST, "pivot_wide": PIVOT, "boolean_fields": BOOLEANS, "dedupe_last": DEDUPE, "pending_keys": PENDING, "config_table": CONFIGS}
