"""Every registered query against its SQL counterpart, over whole tables."""

import pytest

import __spark_entry__ as entry
import compare
from conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, con, name):
    _, complaints = compare.differences(spark, con, QUERIES[name], ORACLES[name], SMALL)
    assert not complaints


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
