"""Every query against its DuckDB text on the smallest folder."""

import compare
import pytest

import __spark_entry__ as entry_module
import oracles
from tallybook.queries import QUERIES

ORACLES = oracles.sql()


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf, duck):
    assert compare.difference(QUERIES[name](spark, sf), duck, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
