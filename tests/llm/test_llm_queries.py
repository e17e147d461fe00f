"""Queries with SQL against DuckDB."""

from __future__ import annotations

import pytest
from oracle import assert_same

from matchengine.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir)


def test_twelve_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 13))
