"""Every registered query runs, and gives what its SQL gives."""

import pytest

from tests.compare import duckdb_rows, spark_rows
from tidemill.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert got == duckdb_rows(ORACLES[name], sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, sf_dir):
    assert QUERIES["r9_hybrid_search"](spark, sf_dir).count() > 0
