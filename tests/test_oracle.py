"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query_matches_sql(spark, con, name):
    outcome = compare(spark, con, name, SF_DIR)
    assert outcome.startswith(("ok", "rows")), outcome


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
