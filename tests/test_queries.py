"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from corvane.queries import ORACLE_SQL, QUERIES

from .compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, data, duck):
    same(QUERIES[name](spark, data), duck.sql(ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "query", "pos", "neg"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
