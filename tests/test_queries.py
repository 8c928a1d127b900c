"""Every query of the core that has SQL, against it, on the smallest tables."""

import pytest
from compare import connect, spark_rows, sql_rows

from textloom.plans import registry


@pytest.fixture(scope="module")
def sql(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sql, data, name):
    assert spark_rows(registry.queries()[name](spark, data)) == sql_rows(sql, registry.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
