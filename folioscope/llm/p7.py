"""Problem 7: filling fixed-capacity containers with items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.packing import fingerprint, pack
from folioscope.llm.tokens import with_tokens
from folioscope.runtime import read


def _kinds(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r.container_kind, r.capacity_tokens) for r in read(spark, d, "container_sizes").filter("capacity_tokens > 0").orderBy("container_kind").limit(1000).collect()]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (and every piece of an oversized one) with its container of each kind."""
    documents = read(spark, d, "documents").withColumn("cluster", fingerprint(F.col("text")))
    sized = with_tokens(documents, ["doc_id", "source", "cluster"], "text")
    return pack(sized, "doc_id", "tokens", "cluster", "source", _kinds(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of the space used, for each kind."""
    sizes = spark.createDataFrame(_kinds(spark, d), "container_kind string, capacity bigint")
    used = p7_containers(spark, d).groupBy("container_kind").agg(F.count_distinct("container").alias("containers"), F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(sizes), "container_kind").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
