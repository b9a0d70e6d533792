"""Every registered query against its SQL on the small tables."""

import pytest

from cotejo.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(name, spark, small):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
