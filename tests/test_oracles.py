"""Every registered query against its DuckDB oracle (sf0.001), plus the
driver contract."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
SLOW = {"incremental_load"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["secid", "date", "S", "sigma", "tau", "r", "cp_flag", "V"]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["ok"], r["problems"]
