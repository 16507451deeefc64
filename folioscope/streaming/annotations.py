"""Structured Streaming forms: the latest view over a growing log, event-time counts, and folds with state.

These go beyond batch use: the batch operators define the results, a stream gives the same rows as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators.store import FACT_KEY, FACTS


def log(spark: SparkSession, path: str, schema: str = FACTS, files: int | None = None) -> DataFrame:
    """The annotation log as a stream of new files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def latest(facts: DataFrame, key: Sequence[str] = tuple(FACT_KEY)) -> DataFrame:
    """The last value of each key so far (update or complete mode); late rows count by their own time."""
    newest = F.max(F.struct("annotated_at", "run_id", "value", "meta")).alias("_m")
    return facts.groupBy(*key).agg(newest).select(*key, F.col("_m.value").alias("value"), F.col("_m.meta").alias("meta"), F.col("_m.annotated_at").alias("latest_at"))


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, by, n): counts by event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def upsert(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str] = tuple(FACT_KEY)):
    """Keeps a table of latest values: every batch is reduced to its own latest rows and appended, and readers take the maximum again."""

    def write(batch: DataFrame, number: int) -> None:
        newest = F.max(F.struct("annotated_at", "run_id", "value", "meta")).alias("_m")
        batch.groupBy(*key).agg(newest).select(*key, "_m.*").withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_register(mentions: DataFrame, graph: str = "graph_id") -> DataFrame:
    """(graph, n_characters, last): how many characters each story has named so far, in state that lives between batches."""
    kind = mentions.schema[graph].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split("\x01")) if state.exists else set()
        last = None
        for f in frames:
            seen |= set(f["id"].dropna())
            last = f["id"].iloc[-1]
        state.update(("\x01".join(sorted(x for x in seen if x)),))
        yield pd.DataFrame({graph: [key[0]], "n_characters": [len({x for x in seen if x})], "last": [last]})

    return mentions.groupBy(graph).applyInPandasWithState(step, f"{graph} {kind}, n_characters int, last string", "seen string", "update", GroupStateTimeout.NoTimeout)
