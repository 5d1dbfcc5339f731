import pytest
from oracle import connect, differences

from sheetloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
