from __future__ import annotations

import numpy as np
import pytest
from data import by

from pyspark.sql import functions as F

from clientpulse.operators import distribution as d
from clientpulse.operators import metrics, profile

RNG = np.random.default_rng(3)
N = 900
# a third of all rows share one score
SCORES = [0.5 if i % 3 == 0 else round(float(x), 2) for i, x in enumerate(RNG.random(N))]
LABELS = [int(x) for x in RNG.random(N) < 0.3]
SEGMENTS = ["a" if i < 850 else "b" for i in range(N)]
IDS = [int(x) for x in RNG.permutation(N)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = list(zip(IDS, LABELS, SCORES, SEGMENTS))
    return spark.createDataFrame(rows, "client_id long, label int, prediction_score double, segment string").persist()


def top(rows, percent):
    k = max(1, -(-len(rows) * percent // 100))
    return sorted(rows, key=lambda r: (-r[2], r[0]))[:k]


@pytest.mark.parametrize("as_text", [True, False])
@pytest.mark.parametrize("rows_per_range", [1, 7, 50_000])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_totals(spark, as_text, rows_per_range, groups):
    values = {(g, k): (k * 7) % 5 + 1 for g in ("x", None) for k in range(-50, 50) if g == "x" or k % 3 == 0}
    rows = [(g, k, v) for (g, k), v in values.items() if groups or g == "x"]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    if as_text:
        rows = [(g, f"{k:+04d}", v) for g, k, v in rows]
        df = spark.createDataFrame(rows, "g string, k string, v long")
    found = d.running_totals(df, "k", ["v"], groups, rows_per_range).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.v_before == sum(v for g, k, v in rows if g == r.g and k < r.k)
        assert r.v_total == sum(v for g, k, v in rows if g == r.g)


@pytest.mark.parametrize("values", [[], [3.0], [1.0] * 50 + [2.0] * 3, [float(x) for x in RNG.normal(size=500)]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    row = d.quantiles(df, ["x"], {"p0": 0.0, "p25": 0.25, "p90": 0.9, "p100": 1.0}).first()
    if not values:
        assert row is None
        return
    for name, q in (("p0", 0), ("p25", 0.25), ("p90", 0.9), ("p100", 1)):
        assert row[name] == pytest.approx(np.quantile(values, q))
    assert row.distinct_count == len(set(values))
    near = d.quantiles(df, ["x"], {"m": 0.5}, exact=False, relative_error=0.001).first()
    assert near.m in values


@pytest.mark.parametrize("rows_per_range", [50_000, 5])
def test_topk_with_a_hot_score(scored, monkeypatch, rows_per_range):
    monkeypatch.setattr(d, "ROWS_PER_RANGE", rows_per_range)
    rows = list(zip(IDS, LABELS, SCORES))
    found = by(metrics.topk_metrics(scored, percents=(1, 5, 10, 60)), "top_percent")
    for percent in (1, 5, 10, 60):
        expected = top(rows, percent)
        assert found[percent]["top_k_count"] == len(expected)
        assert found[percent]["positive_count"] == sum(r[1] for r in expected)
        assert found[percent]["precision_at_k"] == pytest.approx(sum(r[1] for r in expected) / len(expected))
        assert found[percent]["recall_at_k"] == pytest.approx(sum(r[1] for r in expected) / sum(LABELS))


def test_topk_by_segment_and_membership(scored):
    found = by(metrics.topk_metrics(scored, by=["segment"]), "segment", "top_percent")
    for s in "ab":
        rows = [r for r in zip(IDS, LABELS, SCORES, SEGMENTS) if r[3] == s]
        for percent in (1, 5, 10):
            assert found[s, percent]["positive_count"] == sum(r[1] for r in top(rows, percent))
    end = d.topk_cutoffs(scored, percents=[60]).first()
    inside = d.in_top(F.col("prediction_score"), F.col("client_id"), F.lit(end.cutoff_score), F.lit(end.cutoff_id))
    members = {r.client_id for r in scored.where(inside).collect()}
    assert members == {r[0] for r in top(list(zip(IDS, LABELS, SCORES)), 60)}


def test_overlap(scored):
    both = scored.withColumn("other", 1 - F.col("prediction_score"))
    found = by(metrics.topk_overlap(both, "prediction_score", "other", [5, 60]), "top_percent")
    first = {r[0] for r in top(list(zip(IDS, LABELS, SCORES)), 60)}
    second = {r[0] for r in top([(i, y, 1 - s) for i, y, s in zip(IDS, LABELS, SCORES)], 60)}
    assert found[60]["overlap_count"] == len(first & second)
    assert found[60]["first_only_count"] == len(first - second)


def test_overlap_takes_k_from_all_rows(scored):
    part = F.when(F.col("client_id") < 20, 1 - F.col("prediction_score"))
    found = by(metrics.topk_overlap(scored.withColumn("other", part), "prediction_score", "other", [1, 60]), "top_percent")
    assert [found[p]["top_k_count"] for p in (1, 60)] == [9, 540]
    first = {r[0] for r in top(list(zip(IDS, LABELS, SCORES)), 60)}
    both = len(first & set(range(20)))
    assert (found[60]["overlap_count"], found[60]["first_only_count"], found[60]["second_only_count"]) == (both, 540 - both, 20 - both)
    none = metrics.topk_overlap(scored.withColumn("other", F.lit(None).cast("double")), "prediction_score", "other", [5])
    assert none.first().second_only_count == 0 and none.first().first_only_count == 45


@pytest.mark.parametrize("rows_per_range", [50_000, 2])
def test_null_segments_and_text_ids(scored, monkeypatch, rows_per_range):
    monkeypatch.setattr(d, "ROWS_PER_RANGE", rows_per_range)
    segment = F.when(F.col("segment") == "a", "a")
    df = scored.select(F.format_string("id%05d", "client_id").alias("client_id"), "label", "prediction_score", segment.alias("segment"))
    found = by(metrics.topk_metrics(df, by=["segment"]), "segment", "top_percent")
    for s in ("a", None):
        rows = [(f"id{i:05d}", y, x) for i, y, x, g in zip(IDS, LABELS, SCORES, SEGMENTS) if (g == "a") == (s == "a")]
        for percent in (1, 5, 10):
            expected = top(rows, percent)
            assert found[s, percent]["top_k_count"] == len(expected)
            assert found[s, percent]["positive_count"] == sum(r[1] for r in expected)
    text = scored.select(F.format_string("id%05d", "client_id").alias("k"))
    assert d.smallest_key_cutoff(text, "k", 10) == "id00009"


def test_auc(scored):
    s, y = np.array(SCORES), np.array(LABELS)
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    row = metrics.auc_exact(scored).first()
    assert row.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    binned = metrics.auc_binned(scored)
    assert row.roc_auc == pytest.approx(binned["roc_auc"], abs=1e-9)
    assert row.pr_auc == pytest.approx(binned["pr_auc"], abs=1e-9)


def test_auc_of_one_class_and_of_nothing(scored):
    row = metrics.auc_exact(scored.where("label = 1")).first()
    assert row.roc_auc is None and row.pr_auc is None and row.row_count == sum(LABELS)
    assert metrics.auc_binned(scored.where("label = 1")) == {"roc_auc": None, "pr_auc": None}
    assert metrics.auc_exact(scored.where("false")).first().roc_auc is None
    assert metrics.topk_metrics(scored.where("false")).count() == 0


def test_limit_cutoff(spark):
    df = spark.createDataFrame([(i,) for i in (5, 1, 9, 3, 3, None)], "k long")
    assert [d.smallest_key_cutoff(df, "k", k) for k in (1, 2, 3, 4, 99)] == [1, 3, 3, 5, 9]


def test_thresholds_are_compared_exactly(spark):
    scores = [0.0, 0.009, 0.01, 0.29, 0.57, 0.58, 0.99, 1.0]
    df = spark.createDataFrame([(i, i % 2, s) for i, s in enumerate(scores)], "client_id long, label int, prediction_score double")
    sweep = {round(r.threshold, 2): r for r in metrics.threshold_sweep(df).collect()}
    assert len(sweep) == 99
    for t in (round(i / 100, 2) for i in range(1, 100)):
        assert sweep[t].tp + sweep[t].fp == sum(s >= t for s in scores)
        assert sweep[t].tp == sum(s >= t for i, s in enumerate(scores) if i % 2)
        one = metrics.confusion(df, t).first() if t in (0.29, 0.58) else None
        assert one is None or (one.tp, one.fp, one.tn, one.fn, one.f1) == tuple(sweep[t][c] for c in ("tp", "fp", "tn", "fn", "f1"))


def test_operating_points_prefer_the_lower_threshold_of_equals(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "client_id long, label int, prediction_score double")
    points = by(metrics.operating_points(metrics.threshold_sweep(df)), "operating_point")
    assert points["max_f1"]["threshold"] == 0.11 and points["max_f1"]["f1"] == 1.0
    assert points["precision_ge_40_lowest_threshold"]["threshold"] == 0.01
    assert points["recall_ge_70_highest_threshold"]["threshold"] == 0.90
    assert len(points) == 10


def test_calibration(spark):
    rows = [(i, int(i < 3), 0.95) for i in range(10)] + [(11, 0, 1.0), (12, 0, 0.05)]
    df = spark.createDataFrame(rows, "client_id long, label int, prediction_score double")
    curve = by(metrics.calibration(df), "score_bucket")
    assert len(curve) == 10 and curve["0.5-0.6"]["sample_count"] == 0 and curve["0.5-0.6"]["absolute_gap"] == 0
    assert curve["0.9-1.0"]["sample_count"] == 11
    odd = df.unionByName(spark.createDataFrame([(13, 1, -0.5), (14, 1, 1.5)], df.schema))
    more = by(metrics.calibration(odd), "score_bucket")
    assert more.pop("outside_range")["sample_count"] == 2 and more == curve
    row = metrics.calibration_summary(metrics.calibration(odd)).first()
    assert row.calibration_quality == "FAIL" and row.high_score_overconfident and row.monotonic_actual_positive_rate


def test_score_distribution(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (1.5,), (None,)], "prediction_score double")
    found = by(metrics.score_distribution(df), "bucket")
    assert found["0.0-0.1"]["row_count"] == found["0.3-0.4"]["row_count"] == found["0.9-1.0"]["row_count"] == 1
    assert found["outside_range"]["row_count"] == 2 and found["0.1-0.2"]["row_count"] == 0


def test_feature_stats(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (4, 3.0)], "a long, b double")
    found = by(profile.feature_stats(df, ["a", "b"]), "feature_name")
    assert (found["a"]["zero_count"], found["a"]["distinct_count"], found["a"]["p50"]) == (2, 2, 0.0)
    assert (found["b"]["missing_count"], found["b"]["mean"], found["b"]["p50"]) == (1, 2.0, 2.0)
