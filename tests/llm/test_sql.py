import pytest

from orrery.llm.queries import oracle_sql, queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert same(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir) > 0
