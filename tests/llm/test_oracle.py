"""The queries that SQL can express against their SQL."""

import pytest

from factloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(), ORACLE_SQL[name]) == ""
