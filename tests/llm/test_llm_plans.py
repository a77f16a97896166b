import pytest
from oracle import assert_same, connect

from strandloom.llm import plans

ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_same(spark, sf, con, plans.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - ORACLES.keys()))
def test_query_runs(spark, sf, name):
    plans.queries()[name](spark, sf).collect()
