"""Every registered query of the reference's operators against its SQL."""

import pytest

from tests.oracle import DATA, connect, differences

import factloom.operators.answers
import factloom.operators.catalog
import factloom.operators.extract
import factloom.operators.facts
import factloom.operators.graph
import factloom.operators.guards
import factloom.operators.index
import factloom.operators.profile
import factloom.operators.quality
import factloom.operators.relations
import factloom.operators.reports
import factloom.operators.retrieval
import factloom.operators.rows
import factloom.operators.vocabulary
import factloom.plans.ask
import factloom.plans.cascade
import factloom.plans.planner
import factloom.plans.questions
import factloom.plans.routing
import factloom.sources.snapshots  # noqa: F401
from factloom.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), con, ORACLE_SQL[name]) == ""
