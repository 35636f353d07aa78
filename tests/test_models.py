from __future__ import annotations

import math

import numpy as np
import pytest
from data import by

from pyspark.sql import functions as F

from clientpulse.operators import audit, checks, experiments, metrics, model

CARD = {
    "model_version": "card_v1",
    "feature_order": ["a", "b"],
    "coefficients": [0.5, -0.2],
    "intercept": 0.1,
    "threshold": 0.5,
    "imputation_values": {"a": 0.0, "b": 1.0},
}


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        x, noise = float(rng.normal()), float(rng.normal())
        label = int(x + 0.3 * rng.normal() > 0.5)
        rows.append((i, x if i % 10 else None, noise, int(rng.integers(0, 4)), 1, label))
    schema = "client_id long, signal double, noise double, steps long, constant int, label int"
    return spark.createDataFrame(rows, schema).repartition(3).persist()


def test_card_golden_values(spark):
    rows = spark.createDataFrame([(1, 2.0, 1.0), (2, 0.0, None)], "client_id long, a double, b double")
    found = by(model.score_with_card(rows, CARD), "client_id")
    assert found[1]["prediction_score"] == pytest.approx(sigmoid(0.9)) and found[1]["prediction_label"] == 1
    assert found[1]["decision"] == "likely_to_buy" and found[1]["missing_features_filled"] == []
    assert found[2]["prediction_score"] == pytest.approx(sigmoid(-0.1)) and found[2]["prediction_label"] == 0
    assert found[2]["decision"] == "not_likely_to_buy" and found[2]["missing_features_filled"] == ["b"]


def test_card_fills_absent_columns(spark):
    row = model.score_with_card(spark.createDataFrame([(1, 0.0)], "client_id long, a double"), CARD).first()
    assert row.prediction_score == pytest.approx(sigmoid(-0.1)) and row.missing_features_filled == ["b"]


def test_card_refuses_values_that_are_not_numbers(spark):
    rows = [(1, "2", "x"), (2, "NaN", "1"), (3, "Infinity", "1"), (4, "2", "1")]
    found = by(model.score_with_card(spark.createDataFrame(rows, "client_id long, a string, b string"), CARD), "client_id")
    assert found[1]["invalid_features"] == ["b"] and found[1]["prediction_score"] is None and found[1]["decision"] is None
    assert found[2]["invalid_features"] == ["a"] and found[3]["invalid_features"] == ["a"]
    assert found[4]["prediction_score"] == pytest.approx(sigmoid(0.9))


def test_card_sigmoid_does_not_overflow(spark):
    rows = spark.createDataFrame([(1, 1e6, 0.0), (2, -1e6, 0.0)], "client_id long, a double, b double")
    found = by(model.score_with_card(rows, CARD), "client_id")
    assert found[1]["prediction_score"] == 1.0 and found[2]["prediction_score"] == 0.0


@pytest.mark.parametrize("change", [{"intercept": None}, {"coefficients": [1.0]}, {"imputation_values": {"a": 0.0}}])
def test_bad_cards(spark, change):
    card = {k: v for k, v in {**CARD, **change}.items() if v is not None}
    with pytest.raises(ValueError):
        model.score_with_card(spark.createDataFrame([(1, 0.0)], "client_id long, a double"), card)


def test_fit_score_and_card_agree(planted):
    columns = ["signal", "noise", "steps"]
    fitted = model.fit(planted, columns)
    scored = model.score(fitted, planted)
    assert scored.columns == ["client_id", "label", "prediction_score"]
    card = model.model_card(fitted)
    other = model.score_with_card(planted, card).select("client_id", F.col("prediction_score").alias("p"))
    assert scored.join(other, "client_id").agg(F.max(F.abs(F.col("prediction_score") - F.col("p")))).first()[0] < 1e-9
    bounds = scored.agg(F.min("prediction_score"), F.max("prediction_score")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1
    assert metrics.auc_exact(scored).first().roc_auc > 0.8
    ranks = by(model.coefficient_table(fitted), "feature_name")
    assert ranks["signal"]["rank_among_all_features"] == 1 and len(ranks) == 3
    assert model.card_rows(planted, card).count() == 3


def test_kept_columns_keep_their_type(planted):
    fitted = model.fit(planted, ["signal", "steps"])
    kept = model.score(fitted, planted, "label", "steps")
    assert dict(kept.dtypes) == {"client_id": "bigint", "label": "int", "steps": "bigint", "prediction_score": "double"}


def test_split_does_not_depend_on_partitioning(planted):
    train, test = model.split(planted)
    again, _ = model.split(planted.repartition(7))
    assert {r.client_id for r in train.collect()} == {r.client_id for r in again.collect()}
    assert train.count() + test.count() == 600 and 420 < train.count() < 540


def test_temporal_split_needs_the_same_columns(planted):
    with pytest.raises(ValueError):
        model.temporal_split(planted, planted.drop("noise"))


def test_class_weights(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(4)], "client_id long, label int")
    found = by(model.with_class_weight(df), "client_id")
    assert found[0]["class_weight"] == 2.0 and found[1]["class_weight"] == pytest.approx(4 / 6)


def test_modelling_data_is_validated(spark, planted):
    assert checks.validate_modeling(planted)["row_count"] == 600
    with pytest.raises(ValueError, match="positive and negative"):
        checks.validate_modeling(planted.where("label = 1"))
    with pytest.raises(ValueError, match="duplicate_client_id_count"):
        checks.validate_modeling(planted.union(planted))
    with pytest.raises(ValueError, match="missing required columns: label"):
        checks.validate_modeling(planted.drop("label"))
    with pytest.raises(ValueError, match="invalid_label_count"):
        checks.validate_modeling(planted.withColumn("label", F.when(F.col("client_id") == 5, 7).otherwise(F.col("label"))))


def test_correlations(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.5, 5.0), (4.0, 8.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double, constant double")
    families = {"f": ("x", "y"), "g": ("constant",)}
    zero = by(audit.correlation_matrix(df, families), "feature_left", "feature_right")
    assert zero["x", "y"]["correlation"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 0, 6.5, 8])[0, 1])
    assert zero["x", "constant"]["correlation_status"] == "skipped_constant_feature"
    assert zero["x", "constant"]["correlation"] is None
    skip = by(audit.correlation_matrix(df, families, "skip"), "feature_left", "feature_right")
    assert skip["x", "y"]["correlation"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 6.5, 8])[0, 1])
    summary = by(audit.redundancy_audit(audit.variance_audit(df, families), audit.correlation_matrix(df, families)), "feature_family")
    assert summary["g"]["constant_features"] == "constant" and summary["g"]["average_pairwise_correlation"] is None
    assert summary["f"]["average_null_rate"] == 0.125


def test_family_decisions(spark, planted):
    families = {"overall_activity": ("noise",), "cohort_indicator": ("constant",), "weak": ("steps",), "strong": ("signal",)}
    drops = spark.createDataFrame([("strong", 0.2, 0.0)], "feature_family string, pr_auc_drop_relative double, lift_5pct_drop_relative double")
    found = by(audit.family_decisions(audit.variance_audit(planted, families), audit.correlation_matrix(planted, families), drops), "feature_family")
    assert {k: r["category"] for k, r in found.items()} == {
        "overall_activity": "KEEP_CORE",
        "cohort_indicator": "REMOVE_CONSTANT",
        "weak": "REMOVE_CANDIDATE",
        "strong": "KEEP_SUPPORTING",
    }


def test_families_cover_every_feature_once():
    with pytest.raises(ValueError, match="unmapped_features"):
        audit.check_families(["a", "b"], {"f": ("a",)})
    with pytest.raises(ValueError, match="duplicates"):
        audit.check_families(["a"], {"f": ("a",), "g": ("a",)})


def test_ablation_finds_the_planted_signal(planted):
    table = experiments.ablate(planted, planted, ["signal", "noise"], {"none": [], "noise": ["noise"], "signal": ["signal"]}, max_iter=5)
    found = by(table, "scenario")
    assert found["none"]["pr_auc_drop_relative"] == 0
    assert found["signal"]["recommendation"] == "KEEP" and found["noise"]["pr_auc_drop_relative"] < 0.05


def test_rules():
    base = {"pr_auc": 1.0, "lift_at_5pct": 1.0}

    def verdict(rule, pr, lift):
        return experiments.decide({"pr_auc": pr, "lift_at_5pct": lift}, base, rule)

    assert [verdict("not_worse", *m) for m in ((0.996, 1.0), (0.992, 1.0), (0.98, 2.0))] == ["ADOPT", "INVESTIGATE", "KEEP"]
    assert [verdict("gain", *m) for m in ((1.006, 0.9), (1.0, 1.0), (0.99, 1.0))] == ["ADOPT", "INVESTIGATE", "KEEP"]
    assert [verdict("review", *m) for m in ((1.006, 0.9), (0.9, 0.9))] == ["ADOPT_FOR_REVIEW", "INVESTIGATE"]
    assert [verdict("any_gain", *m) for m in ((1.001, 0.9), (1.0, 1.0))] == ["CANDIDATE", "KEEP"]
    assert [verdict("both_gain", *m) for m in ((1.001, 1.001), (1.001, 1.0))] == ["PROMOTE", "KEEP"]
    assert [experiments.classify_drop(*d) for d in ((0.031, 0), (0, 0.01), (0.009, -1))] == ["KEEP", "KEEP_LOWER_PRIORITY", "REMOVE_CANDIDATE"]


def test_minimal_variant(spark):
    rows = [("full", 0.5, 5.0, 6), ("small", 0.5, 5.0, 2), ("bad", 0.3, 4.0, 1)]
    table = spark.createDataFrame(rows, "variant string, pr_auc double, lift_at_5pct double, added_feature_count int")
    found = by(experiments.minimal_variants(table, "full"), "variant")
    assert [v for v in found if found[v]["recommended"] == "yes"] == ["small"]
    assert [found[r[0]]["decision"] for r in rows] == ["REFERENCE", "KEEP_AS_CANDIDATE", "DROP_FROM_MINIMAL_SET"]
