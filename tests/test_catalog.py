"""Whole results of every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, differences
from data import SF

import __spark_entry__ as entry
from clientpulse.plans import catalog, oracles

QUERIES, ORACLES = catalog.QUERIES, oracles.oracle_sql()
SLOW = {"ablation", "combined_ablation", "pruning", "feature_set_comparison", "benchmark", "family_decisions"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_event_table_is_profiled(spark):
    rows = {r.table_name: r for r in QUERIES["profile_all_events"](spark, SF).collect()}
    assert set(rows) == set(catalog.EVENT_SPECS)
    assert sum(r.row_count for r in rows.values()) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert rows["page_visit"].url_distinct_count > 0 and rows["page_visit"].sku_distinct_count is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 37
