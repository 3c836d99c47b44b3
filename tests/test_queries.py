"""Every registered query against its SQL, and the ones without SQL for a stable result."""

from __future__ import annotations

import pytest
from oracle import compare, rows_of

from equiweave.plans import file_queries, registry, report_queries  # noqa: F401  they register on import


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_is_repeatable(spark, sf_dir, name):
    a, b = (registry.QUERIES[name](spark, sf_dir) for _ in range(2))
    first = rows_of(a.columns, [tuple(r) for r in a.collect()])
    assert first and first == rows_of(b.columns, [tuple(r) for r in b.collect()])
