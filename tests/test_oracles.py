"""Every query with an oracle gives what DuckDB gives; the others run."""

import pytest
from compare import DATA, connect, same

from tracklake import registry

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, con, name):
    same(registry.QUERIES[name](spark, DATA), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
