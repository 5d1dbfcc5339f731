"""Queries of the corpus operators against their SQL."""

import pytest
from oracle import connect, differences

from sheetloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []
