import pytest
from conftest import SF, differences

from tidemark.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(spark, con, name):
    more, less, n = differences(q.QUERIES[name](spark, SF), q.ORACLES[name], con)
    assert not more and not less
    assert n
