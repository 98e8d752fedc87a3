import pytest
from conftest import SF, differences

import __spark_entry__ as entry
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    more, less, _ = differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)
    assert not more and not less


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count()


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
