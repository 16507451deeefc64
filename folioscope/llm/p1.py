"""Problem 1: consensus from several annotators' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.values import name_key
from folioscope.llm.consensus import Scale, consensus
from folioscope.operators.wide import Attribute, declared, latest
from folioscope.runtime import read

TASK, VERSION = "passage-content", 2
ITEM = ["_id", "scheme", "seq", "field"]


def readable(spark: SparkSession, d: str) -> tuple[DataFrame, list[Attribute]]:
    """The latest value of each annotator on each field of each passage, read; unreadable ones are left out."""
    attributes = [a for a in declared(read(spark, d, "task_fields"), TASK, VERSION) if a.kind in ("bool", "enum", "list")]
    written = read(spark, d, "passage_annotations").filter((F.col("task") == TASK) & (F.col("task_version") == VERSION) & F.col("value").isNotNull())
    keyed = written.select("_id", "scheme", "seq", name_key(F.col("field")).alias("f"), name_key(F.col("source_agent")).alias("annotator"), "annotated_at", "value")
    last = latest(keyed, ["_id", "scheme", "seq", "f", "annotator"], "annotated_at", "value")
    parsed = field = None
    for a in attributes:
        key = "".join(ch for ch in a.name.lower() if ch.isalnum())
        value = a.parse(F.col("value"))
        value = F.array(value.cast("string")) if a.kind != "list" else value
        parsed = F.when(F.col("f") == key, value) if parsed is None else parsed.when(F.col("f") == key, value)
        field = F.when(F.col("f") == key, a.name) if field is None else field.when(F.col("f") == key, a.name)
    # behind a generator, so that a value is read once
    read_once = F.explode(F.array(F.struct(parsed.alias("value")))).alias("p")
    votes = last.select("_id", "scheme", "seq", field.alias("field"), "annotator", read_once).select("_id", "scheme", "seq", "field", "annotator", F.col("p.value").alias("value"))
    return votes.filter("field IS NOT NULL AND value IS NOT NULL"), attributes


def _consensus(spark: SparkSession, d: str):
    votes, attributes = readable(spark, d)
    scales = [Scale(a.name, ("false", "true") if a.kind == "bool" else a.vocabulary, a.kind == "list") for a in attributes]
    return consensus(votes.select(F.struct(*ITEM).alias("item"), "field", "annotator", "value"), scales), [a for a in attributes if a.kind == "list"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    (labels, *_), sets = _consensus(spark, d)
    of_set = F.col("item.field").isin([a.name for a in sets])
    label = F.when(of_set, F.substring_index("question", ":", -1))
    return labels.select("item._id", "item.scheme", "item.seq", "item.field", label.alias("label"), "value", "posterior", "annotators")


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """Consensus value, its posterior and the number of annotators, per item (and label of a list)."""
    return _labels(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d).filter("label IS NULL OR value = 'true'")
    return labels.select("_id", "scheme", "seq", "field", F.coalesce("label", "value").alias("value"))


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of each annotator on each question, and the joint witness it belongs to."""
    (_, reliability, _, dependence), _ = _consensus(spark, d)
    return reliability.join(F.broadcast(dependence), "annotator", "left")


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Chance-corrected agreement per question."""
    return _consensus(spark, d)[0][2]


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels, "p1_annotators": p1_annotators, "p1_agreement": p1_agreement}
ORACLES: dict[str, str] = {}
