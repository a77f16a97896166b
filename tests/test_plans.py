import pytest
from oracle import assert_same, connect

from strandloom import plans

ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


#: Queries that have no rows on the smallest tables.
LARGER = ["bias_bins", "bias_bins_trimmed", "bias_box", "novel_isoforms", "nr_isoforms"]


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_its_sql_on_larger_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    assert con.execute(ORACLES[name]).fetchone()
    assert_same(spark, sf, con, plans.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(LARGER)))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_same(spark, sf, con, plans.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - ORACLES.keys()))
def test_query_runs(spark, sf, name):
    plans.queries()[name](spark, sf).collect()


def test_nothing_outside_imports_llm():
    import pathlib

    root = pathlib.Path(plans.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "strandloom.llm" not in f.read_text()
