"""Structured extraction: cached, retried, validated calls of a pluggable provider, as a DataFrame plan."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.task import TaskSpec, parse_json, validate
from folioscope.runtime import Workspace

CACHE = "key_sha string, task string, model string, raw string, written_at timestamp"
AGAIN = "The last answer could not be read ({error}). Answer with valid JSON of the required form only.\n\n"


class Provider(Protocol):
    """Answers prompts. It is sent to the workers, so it must be picklable; calls must be repeatable by key."""

    name: str

    def call(self, prompt: str, system: str, model: str, temperature: float, max_tokens: int, image: bytes | None = None) -> str: ...


class RuleProvider:
    """A deterministic provider: answers by a rule on the prompt, for tests and for rule-based annotation."""

    name = "rule"

    def __init__(self, rule: Callable[[str], object]):
        self.rule = rule

    def call(self, prompt: str, system: str, model: str, temperature: float, max_tokens: int, image: bytes | None = None) -> str:
        answer = self.rule(prompt)
        return answer if isinstance(answer, str) else json.dumps(answer)


PROVIDERS: dict[str, Callable[..., Provider]] = {"rule": RuleProvider}


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    PROVIDERS[name] = factory


def available_providers() -> list[str]:
    return sorted(PROVIDERS)


def cache_key(prompt: Column, model: Column, spec: TaskSpec, metadata: Column | None = None, image: Column | None = None) -> Column:
    """Digest of all that fixes an answer: prompt, model, instructions, settings, form, metadata and image."""
    parts = [prompt.alias("prompt"), model.alias("model"), F.lit(spec.prompt()).alias("system"), F.lit(spec.temperature).alias("temperature"), F.lit(spec.max_tokens).alias("max_tokens")]
    if metadata is not None:
        parts.append(metadata.alias("metadata"))
    if image is not None:
        parts.append(F.sha2(image, 256).alias("image"))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers, the last one of each key; an absent folder is an empty cache."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).parquet(path)
    return rows.groupBy("key_sha").agg(F.max_by("raw", F.struct("written_at", "raw")).alias("raw"))


def _ask(provider: Provider, spec: TaskSpec, system: str, prompt: str, model: str, image: bytes | None) -> tuple[str | None, str | None, int]:
    """(raw, error, attempts): an answer that can be read, or the last error after all tries."""
    error, asked = "", prompt
    for attempt in range(1, spec.retries + 2):
        try:
            raw = provider.call(asked, system, model, spec.temperature, spec.max_tokens, image)
            validate(parse_json(raw), spec)
            return raw, None, attempt
        except Exception as e:  # a failed call or answer is data here: the batch goes on
            error = str(e)[:300]
            asked = AGAIN.format(error=error) + prompt
    return None, error, spec.retries + 1


def extract(prompts: DataFrame, spec: TaskSpec, provider: Provider, model: str = "rule", prompt: str = "prompt", metadata: Column | None = None, image: str | None = None, cache: str | None = None, force: bool = False, threads: int = 4) -> DataFrame:
    """The columns of `prompts` with key_sha, raw, result (typed), _failed, _error and attempts.

    Keys found in the cache aren't asked again (unless `force`); each distinct other key is asked once,
    `threads` at a time in each partition; a cached answer that can't be read counts as missing. New
    answers are written once into the cache folder (or the shared folder) and read back, so a task that
    runs again doesn't add rows. A row whose tries are used up has a null result and _failed = true.
    """
    spark = prompts.sparkSession
    space = Workspace(spark, "extract")
    keyed = prompts.withColumn("key_sha", cache_key(F.col(prompt), F.lit(model), spec, metadata, F.col(image) if image else None))
    readable = _reader(spec)
    known = spark.createDataFrame([], "key_sha string, raw string")
    if cache and not force:
        known = read_cache(spark, cache).withColumn("_r", readable("raw")).filter("_r IS NOT NULL").select("key_sha", "raw")
    asked = keyed.select("key_sha", F.col(prompt).alias("_p"), (F.col(image) if image else F.lit(None).cast("binary")).alias("_i")).join(known, "key_sha", "left_anti").groupBy("key_sha").agg(F.first("_p").alias("_p"), F.first("_i").alias("_i"))
    system, task = spec.prompt(), spec.name

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                answers = list(pool.map(lambda r: _ask(provider, spec, system, r[0], model, r[1]), zip(f["_p"], f["_i"])))
                yield pd.DataFrame({"key_sha": f["key_sha"], "raw": [a for a, _, _ in answers], "_error": [e for _, e, _ in answers], "attempts": [n for _, _, n in answers]})

    new = space.keep(asked.mapInPandas(call, "key_sha string, raw string, _error string, attempts int"))
    if cache:
        new.filter("raw IS NOT NULL").select("key_sha", F.lit(task).alias("task"), F.lit(model).alias("model"), "raw", F.current_timestamp().alias("written_at")).write.mode("append").parquet(cache)
    answers = known.select("key_sha", "raw", F.lit(None).cast("string").alias("_error"), F.lit(0).alias("attempts")).unionByName(new)
    joined = keyed.join(answers, "key_sha", "left")
    return joined.withColumn("result", F.from_json(readable("raw"), spec.schema())).withColumn("_failed", F.col("result").isNull())


def _reader(spec: TaskSpec):
    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        out = []
        for r in raw:
            try:
                out.append(json.dumps(validate(parse_json(r), spec)) if r is not None else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return read


def parsed(responses: DataFrame, raw: str, spec: TaskSpec) -> DataFrame:
    """Adds result (typed) and _failed to raw answers."""
    return responses.withColumn("result", F.from_json(_reader(spec)(F.col(raw)), spec.schema())).withColumn("_failed", F.col("result").isNull())


def results(extracted: DataFrame, spec: TaskSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Readable results as rows: metadata columns, then the fields; a list result gives one row per record, an empty list none."""
    good = extracted.filter(F.col("result").isNotNull())
    if spec.is_list:
        good = good.withColumn("result", F.explode("result"))
    return good.select(*keep, *[F.col(f"result.{f.name}").alias(f.name) for f in spec.fields])


# ---- sequential extraction --------------------------------------------------------------------

ANSWERS = "text_id string, chunk int, task string, model string, chunk_size int, raw string"


class Fold(Protocol):
    """State carried from chunk to chunk of one text; sent to the workers."""

    def start(self) -> object: ...

    def context(self, state: object) -> str: ...

    def step(self, state: object, result: dict, start: int, end: int) -> object: ...

    def finish(self, state: object) -> dict: ...


def fold_answers(spark: SparkSession, path: str | None, task: str, model: str, chunk: int) -> DataFrame:
    """(text_id, chunk, raw): the answers that a fold of this task, model and chunk size has already got."""
    if path is None:
        return spark.createDataFrame([], ANSWERS).select("text_id", "chunk", "raw")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], ANSWERS).select("text_id", "chunk", "raw")
    mine = (F.col("task") == task) & (F.col("model") == model) & (F.col("chunk_size") == chunk)
    return spark.read.schema(ANSWERS).parquet(path).filter(mine).groupBy("text_id", "chunk").agg(F.max("raw").alias("raw"))


def fold(passages: DataFrame, text_id: str, order: str, text: str, n_words: str, plan: Fold, provider: Provider, system: str = "", model: str = "rule", chunk: int = 10, task: str = "fold", cache: str | None = None, calls: int | None = None) -> DataFrame:
    """(text_id, result JSON, n_passages, n_chunks, n_failed, n_cached, elapsed): texts in parallel, the chunks of a text in order.

    A failed call or unreadable answer leaves the state as it was. The chunks of a text depend on one
    another, so one text is one group; a text is as long as a book.

    With `cache`, answers are kept by task, text, chunk, model and chunk size (not by prompt), and a
    text goes on after the last chunk that has an answer: the state is told again from the kept ones. `calls`
    is the number of new answers a text may ask for before they are written; a lost executor costs no
    more than that for each of its texts.
    """
    spark = passages.sparkSession
    space = Workspace(spark, "fold")
    rows = passages.select(F.col(text_id).cast("string").alias("k"), F.col(order).alias("o"), F.col(text).alias("x"), F.col(n_words).alias("n"))

    def run(key: tuple, frame: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        began = time.monotonic()
        told = dict(zip(kept["chunk"], kept["raw"]))
        frame = frame.sort_values("o", kind="stable")
        texts, words = frame["x"].tolist(), frame["n"].tolist()
        starts = range(0, len(texts), chunk)
        state, failed, new = plan.start(), 0, []
        for k, start in enumerate(starts):
            end = min(start + chunk, len(texts))
            raw = told.get(k)
            if raw is None:
                if calls is not None and len(new) >= calls:
                    break
                body = "\n\n".join(f"[{i}; {words[i]} words]\n{texts[i]}" for i in range(start, end))
                try:
                    raw = provider.call(f"{plan.context(state)}\n\nTEXT:\n{body}", system, model, 0.2, 8192)
                except Exception:  # counted as failed below; it isn't kept, so another run asks again
                    raw = None
                new.append((k, raw))
            try:
                answer = parse_json(raw or "")
                state = plan.step(state, answer if isinstance(answer, dict) else {}, start, end)
            except Exception:  # the chunk is counted as failed and the fold goes on
                failed += 1
        else:
            k = len(starts)
        done = k == len(starts)
        out = [(key[0], c, raw, None, None, None, None, None, None) for c, raw in new if raw is not None]
        out.append((key[0], None, None, json.dumps(plan.finish(state), ensure_ascii=False) if done else None, len(texts), len(starts), failed, len(told), time.monotonic() - began))
        return pd.DataFrame(out, columns=["k", "chunk", "raw", "result", "n_passages", "n_chunks", "n_failed", "n_cached", "elapsed"])

    schema = "k string, chunk int, raw string, result string, n_passages int, n_chunks int, n_failed int, n_cached int, elapsed double"
    finished = None
    while True:
        kept = fold_answers(spark, cache, task, model, chunk).select(F.col("text_id").alias("k"), "chunk", "raw")
        told = kept.join(rows.select("k").distinct(), "k", "left_semi")
        out = space.keep(rows.groupBy("k").cogroup(told.groupBy("k")).applyInPandas(run, schema))
        if cache is not None:
            asked = out.filter("chunk IS NOT NULL").select(F.col("k").alias("text_id"), "chunk", F.lit(task).alias("task"), F.lit(model).alias("model"), F.lit(chunk).alias("chunk_size"), "raw")
            asked.write.mode("append").parquet(cache)
        ended = out.filter("chunk IS NULL AND result IS NOT NULL")
        finished = ended if finished is None else finished.unionByName(ended)
        if calls is None or cache is None:
            break
        # only texts with chunks left are read again
        left = out.filter("chunk IS NULL AND result IS NULL").select("k")
        if left.isEmpty():
            break
        rows = rows.join(left, "k", "left_semi")
    kind = passages.schema[text_id].dataType.simpleString()
    return finished.select(F.col("k").cast(kind).alias(text_id), "result", "n_passages", "n_chunks", "n_failed", "n_cached", "elapsed")


def fold_report(folded: DataFrame) -> DataFrame:
    """(texts, whole, with_failures, chunks, failed): how a batch of folds ended."""
    return folded.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n_failed") == 0).alias("whole"), F.count_if(F.col("n_failed") > 0).alias("with_failures"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed"))


class Cast:
    """The people of a story, as disjoint sets of numbers. The smallest known number of a set stands for it.

    A person's number may be written C7 or C07. Sets only grow: two people said to be one are joined, and
    what the text calls the set is the entry of the number that stands for it, the other entries giving its
    further names. Entering a number anew forgets the further names it had.
    """

    def __init__(self) -> None:
        self.entries: dict[int, dict] = {}
        self.above: dict[int, int] = {}
        self.names: dict[int, list[str]] = {}

    @staticmethod
    def read(written: object) -> int | None:
        found = re.fullmatch(r"C(\d+)", str(written))
        return int(found.group(1)) if found else None

    @staticmethod
    def write(number: int) -> str:
        return f"C{number:02d}"

    @property
    def free(self) -> int:
        """The next number that nobody has."""
        return 1 + max([0, *self.entries, *self.above])

    def stands(self, number: int) -> int:
        path = []
        while number in self.above:
            path.append(number)
            number = self.above[number]
        for passed in path:  # later walks are one step
            self.above[passed] = number
        return number

    def name(self, written: str) -> str:
        number = self.read(written)
        return written if number is None else self.write(self.stands(number))

    def enter(self, entry: dict) -> None:
        number = self.read(entry.get("id"))
        if number is not None:
            self.entries[number] = {k: v for k, v in entry.items() if k != "id"}
            self.names[number] = []
            self.above.pop(number, None)

    def join(self, one: str, other: str) -> None:
        numbers = [self.read(one), self.read(other)]
        if None in numbers:
            return
        low, high = sorted({self.stands(n) for n in numbers}) if self.stands(numbers[0]) != self.stands(numbers[1]) else (None, None)
        if low is None or (low not in self.entries and high not in self.entries):
            return
        if low not in self.entries:  # whoever was entered stands for one who never was
            low, high = high, low
        self.above[high] = low
        for further in [*([self.entries[high].get("name")] if high in self.entries else []), *self.names.pop(high, [])]:
            if further and further not in self.names[low]:
                self.names[low].append(further)

    def people(self) -> list[dict]:
        plain = {"name": "?", "gender": "unknown", "class": "unknown", "notes": "", "intro_text": "", "descriptions": []}
        return [{"id": self.write(n), **plain, **self.entries[n], "aliases": list(self.names[n])} for n in sorted(self.entries) if n not in self.above]

    def listed(self) -> str:
        def one(p: dict) -> str:
            also = f"; also {', '.join(p['aliases'])}" if p["aliases"] else ""
            return f"- {p['id']} is {p['name']}: {p['gender']}, {p['class']}{also}"

        return "\n".join([*map(one, self.people()), f"New people are numbered from {self.write(self.free)} on."])


#: Lists that an answer may hold, with the keys of their items that name people.
TOLD = {"relations": ("a", "b"), "events": ("who", "whom"), "dialogue": ("speaker", "addressee")}


class StoryFold:
    """Characters, relations, events, dialogue and summaries of a story, chunk by chunk."""

    def start(self) -> dict:
        return {"cast": Cast(), "told": {k: [] for k in TOLD}, "plot": []}

    def context(self, state: dict) -> str:
        plot = "\n".join(f"{s['start']} to {s['end']}: {s['text']}" for s in state["plot"])
        return f"People met so far:\n{state['cast'].listed()}\n\nWhat has happened:\n{plot or 'nothing yet, this is the opening'}"

    def step(self, state: dict, result: dict, start: int, end: int) -> dict:
        cast = state["cast"]
        for entry in result.get("new_characters") or []:
            cast.enter(entry)
        for kind, people in TOLD.items():
            for item in result.get(kind) or []:
                if kind == "relations" and not all(item.get(k) for k in ("a", "b", "type")):
                    continue
                item = {k: cast.name(v) if k in people and v else v for k, v in item.items()}
                state["told"][kind].append(item)
                if item.get("type") == "same_as" and kind == "relations":
                    cast.join(item["a"], item["b"])
        if result.get("chunk_summary"):
            state["plot"].append({"start": start, "end": end - 1, "text": result["chunk_summary"]})
        return state

    def finish(self, state: dict) -> dict:
        return {"characters": state["cast"].people(), **state["told"], "summaries": state["plot"]}
