"""Every registered query against its DuckDB SQL over the smallest tables."""

import pytest
from small_tables import SMALL

import __spark_entry__ as contract
import check


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", contract.queries())
def test_query(spark, con, name):
    assert check.compare(spark, con, SMALL, name) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
