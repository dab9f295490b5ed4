"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from check import compare, duck

from lexiframe.plans import all_queries

QUERIES, CHECKS = all_queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], CHECKS.get(name), sf) is None


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 200
    assert queries().keys() >= oracle_sql().keys()
