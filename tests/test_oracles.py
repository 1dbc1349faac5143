"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

from checks import all_queries
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def conn():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_oracle(spark, conn, key):
    ok, note = compare(spark, conn, SF, QUERIES[key], ORACLES.get(key))
    assert ok, note
