"""Structured extraction with a deterministic provider."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from folioscope.operators import segment as S
from folioscope.plans import extract as E
from folioscope.plans.task import Field, TaskSpec, register_task
from folioscope.runtime import read

SHAPE = register_task(TaskSpec("text-shape", (Field("n_words", "int"), Field("has_quote", "bool"), Field("size", "enum", ("short", "medium", "long"))), system="Describe the text.", retries=1))
NAMES = register_task(TaskSpec("text-names", (Field("name"), Field("place", "int")), is_list=True, system="List the names."))


def shape_rule(prompt: str) -> str:
    """Answers about the text after TEXT:, in the ways models answer: bare, fenced, wrapped, or wrong at first."""
    body = prompt.rpartition("TEXT:\n")[2]
    n = len(body.split())
    answer = {"n_words": n, "has_quote": '"' in body, "size": "short" if n < 50 else "medium" if n < 300 else "long"}
    ways = [json.dumps(answer), f"```json\n{json.dumps(answer)}\n```", f"Here it is: {json.dumps(answer)} Done.", json.dumps({"properties": answer}), json.dumps({k: {"type": "x", "value": v} for k, v in answer.items()})]
    if n % 7 == 6 and not prompt.startswith("The last answer"):
        return "I can't say."
    return ways[n % 5]


def names_rule(prompt: str) -> list:
    body = prompt.rpartition("TEXT:\n")[2]
    return [{"name": m.group(), "place": m.start()} for m in re.finditer(r"\b[A-Z][a-z]{6,}\b", body)]


def _prompts(s, d):
    docs = read(s, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.concat(F.lit("Describe this.\nTEXT:\n"), "text").alias("prompt"))


def extract_map(s, d):
    out = E.extract(_prompts(s, d), SHAPE, E.RuleProvider(shape_rule))
    return E.results(out, SHAPE, ["doc_id", "attempts"])


EXTRACT = r"""SELECT doc_id, CAST(CASE WHEN n % 7 = 6 THEN 2 ELSE 1 END AS INT) AS attempts, n AS n_words, contains(text, '"') AS has_quote, CASE WHEN n < 50 THEN 'short' WHEN n < 300 THEN 'medium' ELSE 'long' END AS size
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[\s\x{A0}]+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)"""


def extract_list(s, d):
    docs = read(s, d, "documents").select("doc_id", F.concat(F.lit("TEXT:\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
    return E.results(E.extract(docs, NAMES, E.RuleProvider(names_rule)), NAMES, ["doc_id"])


def parse_responses(s, d):
    """Answers of many forms about the number of characters of a document."""
    n = F.col("n_chars").cast("string")
    form = F.pmod("doc_id", F.lit(6))
    answer = (
        F.when(form == 0, F.concat(F.lit('{"n": '), n, F.lit("}"))).when(form == 1, F.concat(F.lit('```json\n{"n": '), n, F.lit("}\n```"))).when(form == 2, F.concat(F.lit('So: {"n": '), n, F.lit("} ok")))
        .when(form == 3, F.concat(F.lit("{'n': "), n, F.lit(",}"))).when(form == 4, F.concat(F.lit('{"n": '), n)).otherwise("no idea")
    )
    spec = TaskSpec("count", (Field("n", "int"),))
    out = E.parsed(read(s, d, "documents").select("doc_id", answer.alias("raw")), "raw", spec)
    return out.select("doc_id", F.coalesce("result.n", F.lit(-1)).alias("n"), "_failed")


PARSE = "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN -1 ELSE coalesce(n_chars, -1) END AS n, doc_id % 6 = 5 OR n_chars IS NULL AS _failed FROM documents"


def story_rule(prompt: str) -> dict:
    """Characters of the passages in turn; every fourth name is said to be the one before it."""
    found = sorted(set(re.findall(r"\b[A-Z][a-z]{8,}\b", prompt.rpartition("TEXT:")[2])))[:6]
    start = int(re.search(r"numbered from C(\d+)", prompt).group(1))
    new = [{"id": f"C{start + i:02d}", "name": n} for i, n in enumerate(found)]
    same = [{"a": new[i]["id"], "b": new[i - 1]["id"], "type": "same_as"} for i in range(3, len(new), 4)]
    met = [{"a": x["id"], "b": y["id"], "type": "meets"} for x, y in zip(new, new[1:])]
    return {"new_characters": new, "relations": same + met, "chunk_summary": f"{len(new)} people"}


def sequential_fold(s, d):
    p = S.fixed_windows(read(s, d, "documents"), "doc_id", "text", 60)
    out = E.fold(p, "doc_id", "seq", "text", "n_words", E.StoryFold(), E.RuleProvider(story_rule), chunk=3)
    doc = F.from_json("result", "characters array<struct<id:string,name:string,aliases:array<string>>>, relations array<struct<a:string,b:string,type:string>>, summaries array<struct<start:int,end:int,text:string>>")
    return out.withColumn("r", doc).select("doc_id", "n_passages", "n_chunks", "n_failed", F.size("r.characters").alias("characters"), F.size("r.relations").alias("relations"), F.size("r.summaries").alias("summaries"))


QUERIES = {"extract_map": extract_map, "extract_list": extract_list, "parse_json_responses": parse_responses, "sequential_fold": sequential_fold}
ORACLES = {"extract_map": EXTRACT, "parse_json_responses": PARSE}
