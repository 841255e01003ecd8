import pytest
from compare import rows_of, rows_of_sql
from conftest import SMALL

from spanloom import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SMALL)) == rows_of_sql(registry.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
