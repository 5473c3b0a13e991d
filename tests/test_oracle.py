"""Every query with oracle SQL gives the same rows as the SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, run

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["ate", "n_rows", "share_kept"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, sf, name):
    _, problem = run(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert problem is None or problem.startswith("inexact")
