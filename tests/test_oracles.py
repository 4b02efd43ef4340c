"""Every registered query with SQL gives the rows that DuckDB gives, at the small scale and, for some, empty tables."""

import pytest

from tests.oracle import differences, duck
from tidelog.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_as_sql(spark, small, name):
    assert name in registry.oracle_sql()
    assert differences(registry.queries()[name], registry.oracle_sql()[name], spark, small, duck(small)) is None


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) == set(registry.queries())
