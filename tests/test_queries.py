"""Every query runs at the smallest size; those with SQL give the SQL's rows."""

import pytest

from spindrift.plans import catalogue

from .oracle import by_spark, by_sql

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
EXAMPLES, EXAMPLE_SQL = catalogue.examples()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = by_spark(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert got == by_sql(ORACLES[name], SF)
    else:
        assert got[0]


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    got = by_spark(EXAMPLES[name](spark, SF))
    if name in EXAMPLE_SQL:
        assert got == by_sql(EXAMPLE_SQL[name], SF)
    else:
        assert got[0]


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
