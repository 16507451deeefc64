"""Problem 3: attribute-value rows into wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import wide
from folioscope.runtime import read

KEYS = ["_id", "scheme", "seq"]


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[wide.Attribute]]:
    attributes = wide.declared(read(spark, d, "task_fields"), "passage-form")
    facts = read(spark, d, "passage_annotations").filter(F.col("task") == "passage-form")
    return wide.widen(facts, KEYS, "field", "value", "annotated_at", attributes), attributes


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per passage with a typed column per field; the list column is joined so that rows can be compared."""
    table, attributes = _wide(spark, d)
    return table.withColumns({a.name: F.array_join(a.name, "|") for a in attributes if a.kind == "list"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    table, attributes = _wide(spark, d)
    return wide.cells(table, KEYS, attributes)


_CELLS = r"""
WITH f AS (SELECT field, kind, vocabulary, regexp_replace(lower(field), '[^\p{L}\p{N}]+', '', 'g') AS fk FROM task_fields WHERE task = 'passage-form'),
w AS (SELECT _id, scheme, seq, regexp_replace(lower(field), '[^\p{L}\p{N}]+', '', 'g') AS fk,
             arg_max(value, (annotated_at, value)) AS value
      FROM passage_annotations WHERE task = 'passage-form' AND value IS NOT NULL GROUP BY ALL),
c AS (SELECT _id, scheme, seq, field, kind, vocabulary, trim(regexp_replace(value, '\s+', ' ', 'g')) AS v FROM w JOIN f USING (fk)),
k AS (SELECT *, lower(v) AS lv, regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g') AS vk,
             CASE WHEN v SIMILAR TO '\[.*\]' THEN trim(v[2:-2]) WHEN v SIMILAR TO '[^\[\]{}]+' THEN v END AS inner_text FROM c),
l AS (SELECT *, CASE WHEN kind <> 'list' OR inner_text IS NULL THEN NULL WHEN inner_text = '' THEN []::VARCHAR[]
       ELSE list_transform(regexp_split_to_array(inner_text, '\s*[,;|]\s*'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')) END AS item_keys,
       list_transform(vocabulary, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')) AS vocab_keys FROM k),
t AS (SELECT _id, scheme, seq, field, CASE kind
  WHEN 'bool' THEN CASE WHEN lv IN ('true', 'yes', '1', 't', 'y') THEN 'true' WHEN lv IN ('false', 'no', '0', 'f', 'n') THEN 'false' END
  WHEN 'int' THEN CASE WHEN regexp_full_match(v, '[+-]?\d{1,3}(,\d{3})+(\.0*)?') OR regexp_full_match(v, '[+-]?\d+(\.0*)?')
                       THEN CAST(CAST(regexp_replace(replace(v, ',', ''), '\.0*$', '') AS BIGINT) AS VARCHAR) END
  WHEN 'float' THEN printf('%.4f', CASE WHEN regexp_full_match(rtrim(rtrim(lv, '%')), '[+-]?(\d+([.,]\d*)?|[.,]\d+)(e[+-]?\d+)?')
                       THEN TRY_CAST(replace(rtrim(rtrim(lv, '%')), ',', '.') AS DOUBLE) / CASE WHEN lv LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END END)
  WHEN 'enum' THEN CASE WHEN list_contains(vocab_keys, vk) THEN vocabulary[list_position(vocab_keys, vk)] END
  WHEN 'str' THEN nullif(v, '')
  WHEN 'list' THEN CASE WHEN len(list_filter(item_keys, lambda x: NOT list_contains(vocab_keys, x))) = 0 AND item_keys IS NOT NULL
       THEN array_to_string(list_sort(list_distinct(list_transform(item_keys, lambda x: vocabulary[list_position(vocab_keys, x)]))), '|') END END AS value,
  CASE WHEN kind = 'float' AND regexp_full_match(rtrim(rtrim(lv, '%')), '[+-]?(\d+([.,]\d*)?|[.,]\d+)(e[+-]?\d+)?')
       THEN TRY_CAST(replace(rtrim(rtrim(lv, '%')), ',', '.') AS DOUBLE) / CASE WHEN lv LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END END AS share FROM l)
"""
FOUND_SQL = _CELLS + "SELECT _id, scheme, seq, field, value FROM t WHERE value IS NOT NULL"
#: The fields of the task, as task_fields declares them.
FIELDS = {"confidence": "float", "devices": "list", "dialogue_share": "float", "gloss": "str", "has_footnote": "bool", "is_epistolary": "bool", "is_framed": "bool", "mean_sentence_len": "float", "n_asides": "int", "n_speakers": "int", "opening_words": "str", "person": "enum", "tense": "enum", "verse_share": "float", "word_total": "int"}
_TYPED = {"bool": "CAST(max(value) FILTER (field = '{0}') AS BOOLEAN)", "int": "CAST(max(value) FILTER (field = '{0}') AS BIGINT)", "float": "max(share) FILTER (field = '{0}')"}
WIDE_SQL = _CELLS + "SELECT e._id, e.scheme, e.seq, " + ", ".join(_TYPED.get(kind, "max(value) FILTER (field = '{0}')").format(name) + f' AS "{name}"' for name, kind in FIELDS.items()) + """
FROM (SELECT DISTINCT _id, scheme, seq FROM passage_annotations WHERE task = 'passage-form') e
LEFT JOIN t ON t._id IS NOT DISTINCT FROM e._id AND t.scheme IS NOT DISTINCT FROM e.scheme AND t.seq IS NOT DISTINCT FROM e.seq GROUP BY ALL"""
QUERIES = {"p3_found": p3_found, "p3_wide": p3_wide}
ORACLES = {"p3_found": FOUND_SQL, "p3_wide": WIDE_SQL}
