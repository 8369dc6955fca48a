"""Each query against its SQL over the smallest common tables."""

import pytest
from oracle import duck_rows, spark_rows

from pergola.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, smallest, name):
    assert spark_rows(catalog.QUERIES[name](spark, smallest)) == duck_rows(catalog.SQL[name], smallest)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark, smallest):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
