"""Every registered query against its SQL, and the driver's entry."""

import pytest

import __spark_entry__ as entry
from hawkframe.catalog import all_queries, all_sql
from oracle import compare, connect

QUERIES, SQL = all_queries(), all_sql()
# Random trees and kernels have no SQL; they are tested in test_models.
WITHOUT_SQL = {"distinct_window_approx", "iforest", "ocsvm", "anomaly_stats"}
# Needs more rows than the smallest tables hold.
MAY_BE_EMPTY = {"volume_spike"}


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


def test_every_query_has_sql_but_the_named_ones():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    issue = compare(QUERIES[name](spark, sf), con, SQL[name])
    assert issue is None or (issue == "no rows" and name in MAY_BE_EMPTY), issue


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"alert_id", "severity", "threat_score"} <= set(df.columns)
