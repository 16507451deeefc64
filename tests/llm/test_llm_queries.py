"""The registered queries over the smallest tables."""

import pytest

from folioscope.llm import queries
from tests.compare import DATA, check, connection

QUERIES, SQL = queries.queries(), queries.oracles()
FOUND = {
    "p1_found": ["_id", "scheme", "seq", "field", "value"], "p2_found": ["_id", "root", "member"], "p4_found": ["name_id_a", "name_id_b"],
    "p5_found": ["id_first", "id_other"], "p6_found": ["basket", "item_a", "item_b"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name], connection())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, DATA)
    rows = frame.collect()
    if name in FOUND:
        assert frame.columns == FOUND[name] and len(set(rows)) == len(rows) > 0
