"""Every registered query against its SQL, and the driver's entry point."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle_check import connect, differences
from workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    assert differences(spark, duck, QUERIES[name], ORACLES[name], small) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_and_names(spark):
    assert contract.entry(spark).columns == ["issue", "is_present", "findings"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
