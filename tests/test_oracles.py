"""Every query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from oracle import DATA, expected, got

from tilespark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert got(catalog.QUERIES[name](spark, DATA)) == expected(catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
