"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from conftest import SF_SMALL

NAMES = list(E.QUERIES)                     # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    problems, _, _ = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "month_num", "month_name", "revenue"]
    assert df.count() >= 0
