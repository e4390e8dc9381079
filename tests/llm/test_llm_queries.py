import pytest
from conftest import assert_same

from cellforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(name, spark, sf_dir, duck):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
