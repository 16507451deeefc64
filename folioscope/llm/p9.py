"""Problem 9: text cut off by field limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.truncation import cut_off, judge
from folioscope.runtime import read


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_off(read(spark, d, "documents")).filter("cut").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """For each source its texts, those cut off, and the rate."""
    judged = cut_off(read(spark, d, "documents"))
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_off"), F.avg(F.col("cut").cast("double")).alias("rate"))


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many of the texts cut off each rule found."""
    return judge(read(spark, d, "documents")).filter("cut").groupBy("rule").agg(F.count(F.lit(1)).alias("cut_off"))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates, "p9_rules": p9_rules}
ORACLES: dict[str, str] = {}
