"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.mixing import mix
from folioscope.llm.tokens import with_tokens
from folioscope.runtime import read


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = [(r.source, r.target_share, r.max_repeats) for r in read(spark, d, "mix_targets").limit(10_001).collect()]
    listed = read(spark, d, "documents").join(read(spark, d, "mix_targets").select("source"), "source", "left_semi")
    return mix(with_tokens(listed, ["doc_id", "source"], "text"), "doc_id", "tokens", "source", targets)


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with the number of their copies."""
    return _mixed(spark, d)[0].select("doc_id", "source", "tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the tokens that each source reached, beside its target."""
    return _mixed(spark, d)[1]


QUERIES = {"p8_documents": p8_documents, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
