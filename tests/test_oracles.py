"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from foliospark import catalog
from tests.duck import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf)) == duck_rows(catalog.ORACLES[name], sf)


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"json_report", "binary_scan"}
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
