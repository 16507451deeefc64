"""Queries over the votes of all agents."""

from pyspark.sql import functions as F

from folioscope.queries import agreement
from tests.compare import DATA


def test_all_agents_vote(spark):
    every = agreement._votes(spark, DATA)
    agents = {r.agent for r in every.select("agent").distinct().collect()}
    assert set(agreement.ORDER) < agents and len({"".join(c for c in a.lower() if c.isalnum()) for a in agents}) == len(agents)
    raw = spark.read.parquet(f"{DATA}/passage_annotations.parquet").filter("task = 'passage-content' AND task_version = 2 AND source_agent IS NOT NULL")
    assert agents == {r.agent for r in agreement._votes(spark, DATA).filter("value IS NOT NULL").select("agent").distinct().collect()}
    assert len(agents) == raw.select(F.regexp_replace(F.lower("source_agent"), r"[^\p{L}\p{N}]+", "")).distinct().count()
    pairs = agreement.QUERIES["pairwise_agreement"](spark, DATA)
    assert {r.agent_a for r in pairs.select("agent_a").union(pairs.select("agent_b")).collect()} == agents
