"""Every query against its SQL; those without SQL give rows."""

import pytest

from conftest import SF
from quillspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
