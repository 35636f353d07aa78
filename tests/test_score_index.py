"""The stored score index against plain rankings."""

from __future__ import annotations

import random
import re

import pytest
from data import by
from pyspark.sql import functions as F

from clientpulse.operators import metrics
from clientpulse.operators.distribution import topk_cutoffs
from clientpulse.operators.score_index import build_index


def plain_top(rows, percent):
    ranked = sorted(((-s, i, y) for i, s, y in rows if s is not None), key=lambda r: (r[0], r[1]))
    k = max(1, (len(ranked) * percent + 99) // 100)
    return k, sum(y for _, _, y in ranked[:k]), ranked[k - 1]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(3000):
        # a third of all rows share one score
        score = 0.5 if i % 3 == 0 else rnd.randrange(400) / 400
        out.append((f"c{rnd.random():.12f}", None if i % 50 == 7 else score, int(rnd.random() < 0.2), rnd.choice(["a", "b", None])))
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    df = spark.createDataFrame(rows, "client_id string, prediction_score double, label int, segment string")
    return df.repartition(5).persist()


@pytest.fixture(scope="module")
def ranged(spark):
    """Small ranges, so that groups and ties span several."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_cutoffs_equal_plain_ranking(scored, rows, ranged):
    index = build_index(scored)
    assert index.ranges.count() > 1
    found = by(index.cutoffs([1, 5, 10, 60, 100]), "top_percent")
    for p, row in found.items():
        k, hits, last = plain_top([(i, s, y) for i, s, y, _ in rows], p)
        assert (row["k"], row["top_k_count"], row["positives_in_top"], row["cutoff_score"]) == (k, k, hits, -last[0])
        assert row["cutoff_id"] in (None, last[1])


def test_cutoffs_of_null_groups(scored, rows, ranged):
    index = build_index(scored, by=["segment"])
    found = by(index.cutoffs([10]), "segment")
    assert set(found) == {"a", "b", None}
    for segment, row in found.items():
        k, hits, _ = plain_top([(i, s, y) for i, s, y, g in rows if g == segment], 10)
        assert (row["top_k_count"], row["positives_in_top"]) == (k, hits)
    areas = by(metrics.ranking_metrics(index), "segment")
    want = by(metrics.auc_exact(scored, by=["segment"]), "segment")
    assert all(areas[g]["roc_auc"] == pytest.approx(want[g]["roc_auc"]) for g in want)
    assert areas[None]["lift_at_10pct"] is not None


def test_index_equals_the_lazy_plan(scored, ranged):
    index = build_index(scored, by=["segment"])
    columns = index.cutoffs().columns
    assert sorted(map(repr, index.cutoffs().select(columns).collect())) == sorted(map(repr, topk_cutoffs(scored, by=["segment"]).select(columns).collect()))


def test_repeated_ids_are_taken_together(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 0), (2, 0.5, 1), (3, 0.1, 0)], "client_id long, prediction_score double, label int")
    row = build_index(df).cutoffs([25]).first()
    assert (row.cutoff_id, row.top_k_count, row.positives_in_top) == (1, 2, 1)


def test_no_rows(scored):
    index = build_index(scored.where("false"))
    assert index.cutoffs().count() == 0 and metrics.auc_exact(index.ranks, ranks=index.ranks).first().row_count is None


def test_readers_scan_the_index_once_and_open_only_its_ranges(spark, scored, ranged):
    index = build_index(scored)
    plan = index.cutoffs([1])._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sum("pos_before" in s for s in scans) == 1 and sum("m_before" in s for s in scans) == 1
    assert "dynamicpruning" in plan.lower()
    areas = metrics.auc_exact(index.ranks, ranks=index.ranks)._jdf.queryExecution().executedPlan().toString()
    assert areas.count("Scan parquet") == 1 and "Window" not in areas


def test_overlap_runs_nothing_before_it_is_asked(spark, scored, monkeypatch):
    both = scored.withColumn("other", (F.col("prediction_score") * 7) % 1.0)
    indexes = {c: build_index(both, c) for c in ("prediction_score", "other")}
    monkeypatch.setattr(type(scored), "collect", lambda self: pytest.fail("a job ran"))
    lazy = metrics.topk_overlap(both, "prediction_score", "other", [5, 60], indexes=indexes)
    plain = metrics.topk_overlap(both, "prediction_score", "other", [5, 60])
    monkeypatch.undo()
    assert sorted(lazy.collect()) == sorted(plain.collect())
