"""Every registered query against DuckDB on the test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from basketry import registry
from compare import compare

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
SQL = registry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, name):
    compare(spark, SF_DIR, QUERIES[name], SQL[name])


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert "segment" in df.columns
