"""The long-form, versioned annotation store: facts, latest views, wide frames, configurations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import serialize, source_label

FACT_KEY = ["_id", "scheme", "seq", "field", "source_family", "source_agent", "task", "task_version"]
FACTS = "_id string, scheme string, seq bigint, field string, value string, source_family string, source_agent string, task string, task_version int, run_id string, annotated_at timestamp, meta string"
CONFIGS = "config_sha256 string, task string, source_agent string, model string, system_prompt string, schema_json string, examples_json string, temperature double, max_tokens int, task_version int, first_seen timestamp"


def create(spark: SparkSession, database: str = "annotations") -> None:
    """The tables and the latest view, if they don't exist; facts are partitioned by task."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.facts ({FACTS}) USING parquet PARTITIONED BY (task)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.configs ({CONFIGS}) USING parquet")
    latest(spark.table(f"{database}.facts")).createOrReplaceTempView("latest_annotations")


def scan(facts: DataFrame, ids: Sequence[str] = (), fields: Sequence[str] = (), agent: str | None = None, task: str | None = None, version: int | None = None) -> DataFrame:
    """Facts that meet all given conditions, which reach the file scan; an empty or null filter is none."""
    for name, values in (("_id", ids), ("field", fields)):
        if values:
            facts = facts.filter(F.col(name).isin(list(values)))
    for name, value in (("source_agent", agent), ("task", task)):
        if value:
            facts = facts.filter(F.col(name) == value)
    return facts if version is None else facts.filter(F.col("task_version") == version)


def latest(facts: DataFrame, key: Sequence[str] = tuple(FACT_KEY)) -> DataFrame:
    """The last written value of each key, with its meta, time and source label; equal times are decided by run and value."""
    newest = F.struct("annotated_at", "run_id", "value", "meta")
    out = facts.groupBy(*key).agg(F.max(newest).alias("_m"))
    label = [source_label(F.col("source_family"), F.col("source_agent"), F.col("task"), F.col("task_version")).alias("source")] if {"source_family", "source_agent", "task", "task_version"} <= set(key) else []
    return out.select(*key, F.col("_m.value").alias("value"), F.col("_m.meta").alias("meta"), F.col("_m.annotated_at").alias("latest_at"), *label)


def newest_version(facts: DataFrame) -> DataFrame:
    """Only the greatest version of each task."""
    top = facts.groupBy("task").agg(F.max("task_version").alias("task_version"))
    return facts.join(F.broadcast(top), ["task", "task_version"], "left_semi")


def pivot(latest_facts: DataFrame, key: Sequence[str], fields: Sequence[str], booleans: Sequence[str] = ()) -> DataFrame:
    """One row per key and one text column per field; `booleans` are read as true/false. The field list is given, so no job looks for it."""
    wide = latest_facts.groupBy(*key).pivot("field", list(fields)).agg(F.first("value", ignorenulls=True))
    reads = {f: F.when(F.col(f) == "true", F.lit(True)).when(F.col(f) == "false", F.lit(False)) for f in booleans}
    return wide.withColumns(reads) if reads else wide


def boolean_fields(latest_facts: DataFrame) -> DataFrame:
    """Fields whose values are all 'true' or 'false'."""
    odd = F.count_if(F.col("value").isNotNull() & ~F.col("value").isin("true", "false"))
    return latest_facts.groupBy("field").agg(odd.alias("odd"), F.count("value").alias("n")).filter("odd = 0 AND n > 0").select("field")


def keep_last(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in `order`; ties are decided by all other columns, so the result is fixed."""
    rest = [c for c in rows.columns if c not in set(key) | set(order)]
    newest = F.max(F.struct(*order, *rest)).alias("_m")
    return rows.groupBy(*key).agg(newest).select(*key, *[F.col(f"_m.{c}").alias(c) for c in [*order, *rest]])


def to_facts(results: DataFrame, fields: dict[str, str], family: str, agent: str, task: str, version: int, run: str, when: Column, meta: Column | None = None) -> DataFrame:
    """Wide results (_id, scheme, seq, fields) as facts: one row per value; nulls are skipped, empty lists are kept.

    fields: name -> kind (str, bool, int, float, enum, list, struct).
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), serialize(F.col(f), k)).alias("value")) for f, k in fields.items()])
    meta = F.lit("") if meta is None else meta
    rows = results.select("_id", "scheme", "seq", when.alias("annotated_at"), meta.alias("meta"), F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))
    constants = {"source_family": family, "source_agent": agent, "task": task, "run_id": run}
    return rows.withColumns({k: F.lit(v) for k, v in constants.items()} | {"task_version": F.lit(version)}).select(*[c.split()[0] for c in FACTS.split(", ")])


#: Columns of results that describe the call and are never written as values.
RESERVED = frozenset({"prompt", "raw", "result", "key_sha", "model", "attempts", "text", "_failed", "_error", "run_id", "annotated_at"})


def writable(results: DataFrame, key: Sequence[str] = ("_id", "scheme", "seq"), reserved: Iterable[str] = RESERVED) -> list[str]:
    """The columns of results that hold values: all but the key, the reserved ones and those of metadata (meta_...)."""
    return [c for c in results.columns if c not in set(key) | set(reserved) and not c.startswith("meta_")]


HUMAN = "key string, annotator string, edit string, edited_at timestamp"


def add_edits(edits: DataFrame, path: str) -> None:
    """Appends edits (key, annotator, edit JSON, edited_at); nothing is ever overwritten."""
    edits.select(*[c.split()[0] for c in HUMAN.split(", ")]).write.mode("append").parquet(path)


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each annotator on each key; of equal times the greater text, so the result is fixed."""
    return edits.groupBy("key", "annotator").agg(F.max_by("edit", F.struct("edited_at", "edit")).alias("edit"), F.max("edited_at").alias("edited_at"))


def of_same_text(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """(_id, tag): every text gets the tags of all texts of its match group (its own where it has none)."""
    tagged = tags.select("_id", "tag").filter("tag IS NOT NULL").distinct()
    grouped = texts.select("_id", "match_group").filter("match_group IS NOT NULL").distinct()
    shared = tagged.join(grouped, "_id").select("match_group", "tag").distinct().join(grouped, "match_group").select("_id", "tag")
    return tagged.unionByName(shared).distinct()


def append(facts: DataFrame, path: str) -> None:
    """Adds facts to a folder partitioned by task, sorted so that row groups can be skipped by _id."""
    facts.sortWithinPartitions("task", "_id", "scheme", "seq").write.mode("append").partitionBy("task").parquet(path)


def pending(wanted: DataFrame, facts: DataFrame, key: Sequence[str], agent: str) -> DataFrame:
    """Wanted rows that an agent hasn't annotated yet."""
    return wanted.join(facts.filter(F.col("source_agent") == agent).select(*key).distinct(), list(key), "left_anti")


def shard(rows: DataFrame, key: Sequence[str], part: int, parts: int) -> DataFrame:
    """Part `part` of `parts`, by hash of the key: no ranking, so no shuffle."""
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(parts)) == part)


def config_sha256(task: str, model: str, system_prompt: str, schema: dict, examples: list, temperature: float, max_tokens: int, version: int) -> str:
    """Digest of everything that fixes a task's output, whatever the order of keys."""
    canon = json.dumps({"task": task, "model": model, "system_prompt": system_prompt, "schema": schema, "examples": examples, "temperature": temperature, "max_tokens": max_tokens, "task_version": version}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(canon.encode()).hexdigest()


def configs(rows: DataFrame) -> DataFrame:
    """Each configuration once, as first seen."""
    others = [c for c in rows.columns if c not in ("config_sha256", "first_seen")]
    return rows.groupBy("config_sha256").agg(F.min(F.struct("first_seen", *others)).alias("_m")).select("config_sha256", *[F.col(f"_m.{c}").alias(c) for c in ["first_seen", *others]])


def reconstruct(facts: DataFrame, passages: DataFrame, texts: DataFrame, configurations: DataFrame, prompt: Column) -> DataFrame:
    """The prompt behind each annotated passage: facts (with config_sha256 in meta) with passage, text and configuration."""
    asked = facts.select("_id", "scheme", "seq", F.get_json_object("meta", "$.config_sha256").alias("config_sha256")).distinct()
    joined = asked.join(passages, ["_id", "scheme", "seq"]).join(texts, "_id").join(configurations, "config_sha256")
    return joined.select("_id", "scheme", "seq", "config_sha256", prompt.alias("prompt"))
