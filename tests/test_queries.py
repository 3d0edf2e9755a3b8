"""Every registered query against its SQL check, or for rows where SQL has none."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import connect, differences

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        difference = differences(result, con, ORACLES[name])
        assert difference in ("", "both empty"), difference
    else:
        assert result.count() > 0
