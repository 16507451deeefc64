"""Votes of several agents on the fields of a passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import values as V
from folioscope.operators import reliability as R
from folioscope.operators import store as A
from folioscope.runtime import read

KEY = ["_id", "scheme", "seq"]
KINDS = {"has_dialogue": "bool", "is_prose_fiction": "bool", "introduces_new_character": "bool", "narration_mode": "enum", "scene_content": "list"}
ORDER = ["reader_1", "hollin-70b", "larder-14b", "wicket-8b", "brass-mini"]
REF = "reader_1"


def _votes(s, d):
    """Votes of all agents, spellings of one agent merged, values read by the declared fields of the task."""
    fields = read(s, d, "task_fields").filter((F.col("task") == "passage-content") & (F.col("task_version") == 2) & F.col("field").isin(list(KINDS)))
    keys = {r.field: V.label_keys(r.vocabulary) for r in fields.limit(50).collect() if r.vocabulary}
    named = F.create_map(*[F.lit(x) for name in KINDS for x in (V.label_keys([name]).popitem()[0], name)])
    agents = F.create_map(*[F.lit(x) for name in ORDER for x in (V.label_keys([name]).popitem()[0], name)])
    a = read(s, d, "passage_annotations").filter((F.col("task") == "passage-content") & (F.col("task_version") == 2))
    field, agent = F.try_element_at(named, V.name_key(F.col("field"))), V.name_key(F.col("source_agent"))
    a = a.select(*KEY, field.alias("field"), F.coalesce(F.try_element_at(agents, agent), agent).alias("agent"), "annotated_at", F.coalesce("value", F.lit("~")).alias("value"))
    v = A.keep_last(a.filter("field IS NOT NULL AND agent IS NOT NULL"), [*KEY, "field", "agent"], ["annotated_at", "value"])
    value = F.when(F.col("field") == "scene_content", F.to_json(V.as_label_list(F.col("value"), keys["scene_content"])))
    value = value.when(F.col("field") == "narration_mode", V.as_label(F.col("value"), keys["narration_mode"])).otherwise(V.as_bool(F.col("value")).cast("string"))
    return v.select(*KEY, "field", "agent", value.alias("value"))


#: The latest value of each agent on each field, read by the declared fields; every spelling of an agent is one agent.
READ = r"""
raw AS (SELECT _id, scheme, seq, CASE regexp_replace(lower(field), '[^\p{L}\p{N}]+', '', 'g') WHEN 'hasdialogue' THEN 'has_dialogue' WHEN 'isprosefiction' THEN 'is_prose_fiction' WHEN 'introducesnewcharacter' THEN 'introduces_new_character' WHEN 'narrationmode' THEN 'narration_mode' WHEN 'scenecontent' THEN 'scene_content' END AS field,
 regexp_replace(lower(source_agent), '[^\p{L}\p{N}]+', '', 'g') AS ak, annotated_at, coalesce(value, '~') AS value FROM passage_annotations WHERE task = 'passage-content' AND task_version = 2),
l AS (SELECT _id, scheme, seq, field, CASE ak WHEN 'reader1' THEN 'reader_1' WHEN 'hollin70b' THEN 'hollin-70b' WHEN 'larder14b' THEN 'larder-14b' WHEN 'wicket8b' THEN 'wicket-8b' WHEN 'brassmini' THEN 'brass-mini' ELSE ak END AS agent, max((annotated_at, value))[2] AS value
 FROM raw WHERE field IS NOT NULL AND ak IS NOT NULL GROUP BY ALL),
voc AS (SELECT field, vocabulary, list_transform(vocabulary, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')) AS vk FROM task_fields WHERE task = 'passage-content' AND task_version = 2),
sq AS (SELECT l.* EXCLUDE (value), trim(regexp_replace(value, '\s+', ' ', 'g')) AS v, vocabulary, vk FROM l JOIN voc USING (field)),
inn AS (SELECT *, CASE WHEN v SIMILAR TO '\[.*\]' THEN trim(v[2:-2]) WHEN v SIMILAR TO '[^\[\]{}]+' THEN v END AS it FROM sq),
itm AS (SELECT *, CASE WHEN it IS NULL THEN NULL WHEN it = '' THEN []::VARCHAR[] ELSE list_transform(regexp_split_to_array(it, '\s*[,;|]\s*'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')) END AS ik FROM inn),
votes AS (SELECT _id, scheme, seq, field, agent, CASE WHEN field = 'scene_content' THEN CASE WHEN ik IS NOT NULL AND len(list_filter(ik, lambda x: NOT list_contains(vk, x))) = 0 THEN CAST(to_json(list_sort(list_distinct(list_transform(ik, lambda x: vocabulary[list_position(vk, x)])))) AS VARCHAR) END
 WHEN field = 'narration_mode' THEN vocabulary[list_position(vk, regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g'))] WHEN lower(v) IN ('true', 'yes', '1', 't', 'y') THEN 'true' WHEN lower(v) IN ('false', 'no', '0', 'f', 'n') THEN 'false' END AS value FROM itm),
"""
_CONSENSUS = r"""
ord AS (SELECT *, coalesce(list_position(['reader_1', 'hollin-70b', 'larder-14b', 'wicket-8b', 'brass-mini'], agent), 99) AS o FROM counted),
ref AS (SELECT _id, scheme, seq, field, value AS r FROM votes WHERE agent = 'reader_1'),
keys AS (SELECT DISTINCT _id, scheme, seq, field FROM votes),
bw AS (SELECT _id, scheme, seq, field, count(*) FILTER (value = 'true') AS y, count(*) FILTER (value = 'false') AS n, arg_min(value, (o, agent)) FILTER (value IS NOT NULL) AS f FROM ord WHERE field IN ('has_dialogue', 'is_prose_fiction', 'introduces_new_character') GROUP BY ALL),
bv AS (SELECT keys._id, keys.scheme, keys.seq, keys.field, CASE WHEN y > n THEN 'true' WHEN n > y THEN 'false' WHEN coalesce(y + n, 0) = 0 THEN NULL ELSE coalesce(r, f) END AS value FROM keys LEFT JOIN bw USING (_id, scheme, seq, field) LEFT JOIN ref USING (_id, scheme, seq, field) WHERE keys.field IN ('has_dialogue', 'is_prose_fiction', 'introduces_new_character')),
ew AS (SELECT _id, scheme, seq, field, value, count(*) AS n FROM counted WHERE field = 'narration_mode' AND value <> '' GROUP BY ALL),
ev AS (SELECT _id, scheme, seq, field, value FROM (SELECT ew.*, row_number() OVER (PARTITION BY ew._id, ew.scheme, ew.seq ORDER BY n DESC, CASE WHEN value = r THEN 0 ELSE 1 END, value) AS k FROM ew LEFT JOIN ref USING (_id, scheme, seq, field)) WHERE k = 1),
lw AS (SELECT _id, scheme, seq, field, agent, from_json(value, '["VARCHAR"]') AS ls FROM counted WHERE field = 'scene_content' AND value IS NOT NULL),
ln AS (SELECT _id, scheme, seq, field, count(*) AS n FROM lw GROUP BY ALL),
lt AS (SELECT _id, scheme, seq, field, lab, count(*) AS k, bool_or(agent = 'reader_1') AS inref FROM (SELECT _id, scheme, seq, field, agent, unnest(ls) AS lab FROM lw) GROUP BY ALL),
lk AS (SELECT _id, scheme, seq, field, list(lab ORDER BY lab) AS labs FROM lt JOIN ln USING (_id, scheme, seq, field) WHERE 2 * k > n OR (2 * k = n AND inref) GROUP BY ALL),
lv AS (SELECT keys._id, keys.scheme, keys.seq, keys.field, coalesce(CAST(to_json(labs) AS VARCHAR), '[]') AS value FROM keys LEFT JOIN lk USING (_id, scheme, seq, field) WHERE keys.field = 'scene_content'),
won AS (SELECT * FROM bv UNION ALL SELECT keys._id, keys.scheme, keys.seq, keys.field, ev.value FROM keys LEFT JOIN ev USING (_id, scheme, seq, field) WHERE keys.field = 'narration_mode' UNION ALL SELECT * FROM lv),
castv AS (SELECT _id, scheme, seq, field, count(*) AS n, count(DISTINCT value) AS dn, list(value) AS vs FROM counted WHERE value IS NOT NULL AND value <> '[]' GROUP BY ALL),
cons AS (SELECT won._id, won.scheme, won.seq, won.field, won.value, CASE WHEN coalesce(n, 0) = 0 THEN 'no_vote' WHEN n = 1 THEN 'single_vote' WHEN dn = 1 THEN 'unanimous' WHEN list_contains(vs, won.value) THEN 'majority' ELSE 'no_consensus' END AS tier,
 coalesce(n, 0) AS n_votes FROM won LEFT JOIN castv USING (_id, scheme, seq, field))
"""


_VOTES = READ + "counted AS (SELECT * FROM votes)," + _CONSENSUS
#: Only agents that agree with the reference in 80 % of the cases of a field, and one agent not on one field.
_TRUSTED = READ + """rv AS (SELECT _id, scheme, seq, field, value AS r FROM votes WHERE agent = 'reader_1'),
tr AS (SELECT v.agent, v.field, avg(CAST(v.value IS NOT DISTINCT FROM rv.r AS INT)) FILTER (rv._id IS NOT NULL) AS trust FROM votes v LEFT JOIN rv USING (_id, scheme, seq, field) WHERE v.agent <> 'reader_1' GROUP BY ALL),
counted AS (SELECT v.* FROM votes v LEFT JOIN tr USING (agent, field) WHERE (agent = 'reader_1' OR field NOT IN (SELECT field FROM tr) OR coalesce(trust >= 0.8, false)) AND NOT (agent = 'brass-mini' AND field = 'scene_content')),""" + _CONSENSUS


def _consensus(s, d):
    return R.consensus(_votes(s, d), KEY, KINDS, ORDER, REF)


def trust_per_field(s, d):
    return R.trust(_votes(s, d), KEY, REF).select("agent", "field", F.round("trust", 9).alias("trust"), "n")


TRUST = f"WITH {_VOTES} SELECT v.agent, v.field, round(avg(CAST(v.value IS NOT DISTINCT FROM ref.r AS INT)) FILTER (ref._id IS NOT NULL), 9) AS trust, count(ref._id) AS n FROM votes v LEFT JOIN ref USING (_id, scheme, seq, field) WHERE v.agent <> 'reader_1' GROUP BY ALL"


def pairwise_agreement(s, d):
    return R.pairwise(_votes(s, d), KEY).select("agent_a", "agent_b", "field", F.round("agreement", 9).alias("agreement"), "n")


PAIRWISE = f"WITH {_VOTES} SELECT x.agent AS agent_a, y.agent AS agent_b, x.field, round(avg(CAST(x.value IS NOT DISTINCT FROM y.value AS INT)), 9) AS agreement, count(*) AS n FROM votes x JOIN votes y USING (_id, scheme, seq, field) WHERE x.agent < y.agent GROUP BY ALL"


def consensus_tiers(s, d):
    return _consensus(s, d)


def consensus_trusted(s, d):
    """Only agents that agree with the reference in 80 % of the cases count."""
    v = _votes(s, d)
    return R.consensus(v, KEY, KINDS, ORDER, REF, R.allowed(v, REF, R.trust(v, KEY, REF), 0.8, [("brass-mini", "scene_content")])).groupBy("field", "tier").agg(F.count(F.lit(1)).alias("n"))


def audit_flags(s, d):
    v = _votes(s, d)
    c = R.consensus(v, KEY, KINDS, ORDER, REF)
    return R.audit(c, v, KEY, REF).withColumnRenamed("flagged", "differs").join(R.flagged(c, KEY, ["no_consensus", "majority"]), KEY)


AUDIT = f"WITH {_VOTES} SELECT _id, scheme, seq, bool_or(coalesce(value <> r, false)) AS differs, bool_or(tier IN ('no_consensus', 'majority')) AS flagged FROM cons LEFT JOIN ref USING (_id, scheme, seq, field) GROUP BY ALL"


def disagree_flags(s, d):
    return R.disagreements(_votes(s, d), KEY)


DISAGREE = f"WITH {_VOTES} SELECT _id, scheme, seq, field, count(DISTINCT value) AS n_values, count(DISTINCT value) > 1 AS disagree FROM votes GROUP BY ALL"


def human_vs_model(s, d):
    v = _votes(s, d)
    return R.compare(v.filter("agent = 'reader_1'"), v.filter("agent = 'hollin-70b'"), KEY)


HUMAN = f"WITH {_VOTES} SELECT x.field, count(*) FILTER (x.value IS NOT DISTINCT FROM y.value) AS agree, count(*) FILTER (x.value IS DISTINCT FROM y.value) AS disagree, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (x.value IS NOT DISTINCT FROM y.value) / count(*), 1) AS pct FROM votes x JOIN votes y USING (_id, scheme, seq, field) WHERE x.agent = 'reader_1' AND y.agent = 'hollin-70b' GROUP BY 1"


def consensus_facts(s, d):
    out = R.to_facts(_consensus(s, d), "majority", "passage-content", 2, "run9", F.timestamp_seconds(F.lit(1750000000)))
    return out.select("_id", "scheme", "seq", "field", "value", "source_family", "source_agent", F.get_json_object("meta", "$.tier").alias("tier"))


CFACTS = f"WITH {_VOTES} SELECT _id, scheme, seq, field, value, 'derived' AS source_family, 'majority' AS source_agent, tier FROM cons WHERE value IS NOT NULL"

QUERIES = {"trust_per_field": trust_per_field, "pairwise_agreement": pairwise_agreement, "consensus_tiers": consensus_tiers, "consensus_trusted": consensus_trusted, "audit_flags": audit_flags, "disagree_flags": disagree_flags, "human_vs_model": human_vs_model, "consensus_facts": consensus_facts}
ORACLES = {"consensus_trusted": f"WITH {_TRUSTED} SELECT field, tier, count(*) AS n FROM cons GROUP BY 1, 2", "trust_per_field": TRUST, "pairwise_agreement": PAIRWISE, "consensus_tiers": f"WITH {_VOTES} SELECT * FROM cons", "audit_flags": AUDIT, "disagree_flags": DISAGREE, "human_vs_model": HUMAN, "consensus_facts": CFACTS}
