"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from data import SF

from clientpulse.operators import features, labels, paths, targets
from clientpulse.plans.catalog import QUERIES
from clientpulse.sources import fixtures as fx
from clientpulse.sources import read_events, write_events

MODELS = {
    "ablation",
    "combined_ablation",
    "pruning",
    "feature_set_comparison",
    "benchmark",
    "family_decisions",
    "fit_and_score",
    "batch_score",
    "coefficient_table",
    "model_card",
    "velocity_ablation",
    "benchmark_report",
    "coefficient_checks",  # compares features with features, not rows with rows
}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CollectLimit")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert [word for word in FORBIDDEN if word in plan] == []


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "events")
    write_events(fx.order_events(spark, SF), path)
    return path


def test_feature_tree_reads_partitions_and_columns(spark, stored):
    events = read_events(spark, stored)
    plan = plan_of(features.build_features(events, fx.products(spark, SF), fx.ORDERS_SNAPSHOT))
    scans = [s for s in plan.split("FileScan parquet")[1:] if "event_date" in s.split("]")[0]]
    assert len(scans) == 2
    for scan in scans:
        assert "PartitionFilters: [event_type" in scan
        assert "LessThan(event_date,2001-07-02)" in scan
        assert "event_ts" not in scan.split("ReadSchema")[1].split(">")[0]
    # two reduction levels, the day level, one exchange per client, and no sort-merge join on raw events
    assert len(re.findall(r"Exchange hashpartitioning\(client_id#\d+L, sku", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(client_id#\d+L, \d+\)", plan)) == 1
    assert "Window" not in plan


def test_labels_need_one_scan_and_one_shuffle(spark, stored):
    plan = plan_of(labels.labels_from_events(read_events(spark, stored), fx.ORDERS_SNAPSHOT))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert "PartitionFilters: [event_type" in plan


def test_paths_need_no_join(spark, stored):
    events = read_events(spark, stored)
    plan = plan_of(paths.purchase_path(events, fx.ORDERS_SNAPSHOT))
    assert "Join" not in plan and "Window" not in plan and plan.count("FileScan") == 1
    assert "PartitionFilters: [event_type" in plan


def test_recent_searches_need_no_join(spark, stored):
    plan = plan_of(paths.recent_then(read_events(spark, stored), fx.ORDERS_SNAPSHOT.cutoff))
    assert "Join" not in plan and plan.count("Exchange") == 1 and "PartitionFilters: [event_type" in plan


def test_transitions_window_over_slices(spark, stored):
    plan = plan_of(features.transition_features(read_events(spark, stored), fx.ORDERS_SNAPSHOT.cutoff))
    partitions = re.findall(r"windowspecdefinition\(([^)]*?)specifiedwindowframe", plan)
    assert partitions and all("__slice" in p for p in partitions)


def test_targets_read_events_once(spark, stored):
    rows = targets.target_comparison(read_events(spark, stored))
    rows.collect()
    final = plan_of(rows).split("== Initial Plan ==")[0]
    # the second reference, for the bounds, is the reused exchange
    assert final.count("FileScan") == 1 or "ReusedExchange" in final
