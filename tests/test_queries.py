"""Every query of the catalogue against DuckDB, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tests.conftest import duckdb_rows, rows_of
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES
from tidemark.plans.store_oracles import STORE_ORACLES
from tidemark.plans.store_queries import STORE_QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES | STORE_QUERIES))
def test_query_matches_its_sql(spark, data_dir, name):
    df = entry.queries()[name](spark, data_dir)
    got = rows_of(df)
    names, want = duckdb_rows(entry.oracle_sql()[name], data_dir)
    assert sorted(df.columns) == names
    assert got == want


def test_entry(spark, data_dir):
    assert entry.entry(spark).count() > 0


def test_registry_is_complete():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(ORACLES) and set(STORE_QUERIES) == set(STORE_ORACLES)
