"""Registered queries against their SQL, and all of them at the smallest scale."""

import pytest

from metasearch.llm import queries as llm
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, sf, name):
    assert compare(spark, connect(sf), llm.queries()[name], llm.oracle_sql()[name], sf) is None


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs_on_whole_tables(spark, sf, name):
    n = llm.queries()[name](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count() or name == "op6_decontamination" and n > 0


def test_registered_only_with_the_subpackage():
    import __spark_entry__ as e

    assert set(llm.queries()) | {"pipeline"} <= set(e.queries()) and len(llm.queries()) == 10
