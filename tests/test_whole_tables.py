"""Queries that must not leave out a form of text."""

from folioscope.queries import extraction, segments
from tests.compare import DATA


def forms(spark, rows):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "coalesce(form, 'none') AS form")
    return {r.form for r in rows.join(documents, "doc_id").select("form").distinct().collect()}


def test_all_forms(spark):
    for query in (extraction.extract_list, extraction.sequential_fold, segments.mention_windows):
        assert {"prose", "letter", "drama", "none"} <= forms(spark, query(spark, DATA)), query
