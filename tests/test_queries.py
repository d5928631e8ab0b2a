"""Every core query against its SQL on the smallest shared tables."""

import pytest

from broadsheet.plans import catalogue
from tests.oracle import connect, duck_rows, spark_rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = spark_rows(QUERIES[name](spark, data))
    assert len(set(got[0])) == len(got[0])
    if name in SQL:
        assert got == duck_rows(connect(data), SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
