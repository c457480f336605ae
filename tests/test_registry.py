"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

from metasearch import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, duck, name):
    assert compare(spark, duck, registry.QUERIES[name], registry.SQL[name], sf) is None


def test_rows_only(spark, sf):
    for name in sorted(set(registry.QUERIES) - set(registry.SQL)):
        assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists("/root/testdata/sf0.001")
