"""Every registered query against its SQL; rows and types, or at least rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()

# Queries for a cell that lies elsewhere at this scale, or that may find no rule or file error.
MAY_BE_EMPTY = {"c4_drilldown_cell", "c4_mart_drilldown_cell", "d4_mart_cell_summary", "f13_rule_query",
                "f15_rule_search"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, *_ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR,
                           need_rows=name not in MAY_BE_EMPTY)
    assert message == ""
