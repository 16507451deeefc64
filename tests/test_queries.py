"""Every core query over the smallest tables: equal to its SQL where there is one, else it must run."""

import pytest

from folioscope.queries import catalogue
from tests.compare import DATA, check, connection

QUERIES, SQL = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    check(spark, QUERIES[name], SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert len(frame.columns) == len(set(frame.columns))
    frame.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
