"""A lookup opens the buckets of its clients, and of those the row groups that may hold them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from clientpulse.operators import serving
from clientpulse.sources import read_scores, write_scores


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("served") / "scores")
    rows = spark.range(200_000).select(
        # even numbers only, in text order within a bucket
        (F.col("id") * 2).cast("string").alias("client_id"),
        (F.rand(1)).alias("prediction_score"),
        F.lit(1).alias("prediction_label"),
        F.lit("v1").alias("model_version"),
        F.lit("now").alias("scored_at"),
    )
    write_scores(rows, path, buckets=4, row_group_bytes=64 << 10)
    return path


def rows_read(spark, served, ids):
    found = serving.lookup(read_scores(spark, served), ids, buckets=4)
    execution = found._jdf.queryExecution()
    rows = found.collect()
    found_plan = execution.executedPlan()
    text = found_plan.toString()
    stack, read = [found_plan], 0
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        if "Scan parquet" in node.nodeName():
            read += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return rows, read, text


def test_only_matching_row_groups_are_read(spark, served):
    rows, read, plan = rows_read(spark, served, ["123456", "777778"])
    assert sorted(r.client_id for r in rows) == ["123456"]  # the other is beyond the last
    assert 0 < read < 20_000
    assert re.search(r"PartitionFilters: \[client_bucket#\d+ (IN|INSET|=)|PartitionFilters: \[.*client_bucket", plan)


def test_bloom_filters_rule_out_ids_between_others(spark, served):
    rows, read, _ = rows_read(spark, served, [str(i) for i in range(100_001, 100_021, 2)])
    assert rows == [] and read < 5_000


def test_lookup_runs_no_job_before_it_is_asked(spark, served, monkeypatch):
    scores = read_scores(spark, served)
    monkeypatch.setattr(type(scores), "collect", lambda self: pytest.fail("a job ran"))
    found = serving.lookup(scores, ["2", "4", "4"], buckets=4)
    monkeypatch.undo()
    assert sorted(r.client_id for r in found.collect()) == ["2", "4"]
