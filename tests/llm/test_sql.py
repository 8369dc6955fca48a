"""The operators that SQL can express against their SQL, over whole tables."""

import pytest
from oracle import duck_rows, spark_rows

from pergola.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_its_sql(spark, smallest, name):
    assert spark_rows(queries.queries()[name](spark, smallest)) == duck_rows(queries.oracle_sql()[name], smallest)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
