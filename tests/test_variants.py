"""Experiments from shared work against single fits and plain numbers."""

from __future__ import annotations

import re

import numpy as np
import pytest
from data import by
from pyspark.sql import functions as F

from clientpulse.operators import experiments, metrics, model, variants

COLUMNS = ["signal", "weak", "noise", "steps"]


def frame(spark, seed, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, noise = (float(v) for v in rng.normal(size=3))
        label = int(x + 0.5 * y + 0.4 * rng.normal() > 0.6)
        rows.append((i, x if i % 9 else None, y, noise, int(rng.integers(0, 4)), int(rng.integers(0, 30)), int(rng.integers(0, 2)), label))
    schema = "client_id long, signal double, weak double, noise double, steps long, active_days_count long, product_buy_count long, label int"
    return spark.createDataFrame(rows, schema).repartition(3).persist()


@pytest.fixture(scope="module")
def pair(spark):
    return frame(spark, 1), frame(spark, 2)


def test_variants_equal_single_fits(pair):
    train, valid = pair
    sets = {"all": COLUMNS, "two": ["noise", "signal"], "again": ["noise", "signal"], "one": ["steps"]}
    found = variants.run_variants(train, valid, sets)
    for name, columns in sets.items():
        _, want = experiments.fit_and_evaluate(train, valid, columns)
        assert found[name].keys() == want.keys()
        assert all(found[name][k] == pytest.approx(want[k], abs=1e-6) for k in want), name


def test_one_imputation_and_no_fit_of_equal_lists(pair, monkeypatch):
    imputed, fitted = [], []
    imputer, regression = variants.Imputer.fit, variants.LogisticRegression.fit
    monkeypatch.setattr(variants.Imputer, "fit", lambda self, df: imputed.append(1) or imputer(self, df))
    monkeypatch.setattr(variants.LogisticRegression, "fit", lambda self, df: fitted.append(1) or regression(self, df))
    table = experiments.ablate(*pair, COLUMNS, {"signals": ["signal", "weak"], "noise": ["noise"], "none": ["absent"]})
    found = by(table, "scenario")
    assert len(imputed) == 1 and len(fitted) == 3
    assert found["signals"]["recommendation"] == "KEEP" and found["none"]["pr_auc_drop_relative"] == 0
    assert found["noise"]["removed_features"] == "noise" and found["noise"]["feature_count"] == 3


def test_scores_of_all_variants_take_one_scan(pair):
    train, valid = pair
    sets = {"a": ["signal"], "b": ["weak", "noise"]}
    with variants.vectors(train, valid, COLUMNS) as of:
        long = variants.score_variants(of, sets, variants.fit_variants(of, sets))
        plan = long._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"InMemoryTableScan \[[^\]]*features", plan)) == 1
        assert long.groupBy("variant").count().collect() and long.count() == 1000


def test_benchmark_of_sets_equals_benchmark_of_models(pair):
    train, valid = pair
    first, second = ["noise", "weak"], ["signal", "weak"]
    shared = experiments.benchmark_sets(train, valid, first, second)
    single = experiments.benchmark(model.fit(train, first), model.fit(train, second), valid)
    for name, keys in (("overall", ["model"]), ("segments", ["model", "segment_type", "segment_name"]), ("overlap", ["top_percent"])):
        a, b = by(shared[name], *keys), by(single[name], *keys)
        assert a.keys() == b.keys()
        for k in a:
            assert all(a[k][c] == (b[k][c] if isinstance(b[k][c], str) else pytest.approx(b[k][c], abs=1e-6)) for c in a[k])
    assert shared["verdict"].first().verdict == "PROMOTE"
    for name in ("first", "second"):
        one = metrics.auc_exact(model.score(model.fit(train, first if name == "first" else second), valid)).first()
        assert by(shared["overall"], "model")[name]["roc_auc"] == pytest.approx(one.roc_auc, abs=1e-6)


def test_verdict_on_given_scores(spark):
    rows = [(i, int(i < 20), 1.0 - i / 100, 1.0 - ((i * 37) % 100) / 100, "h" if i % 2 else "l", "n" if i % 3 else "r") for i in range(100)]
    joined = spark.createDataFrame(rows, "client_id long, label int, first double, second double, activity_segment string, lifecycle_segment string")
    swapped = joined.select("client_id", "label", "activity_segment", "lifecycle_segment", F.col("first").alias("second"), F.col("second").alias("first"))
    better = experiments.compare_scores(swapped)
    assert better["verdict"].first().asDict() == {"verdict": "PROMOTE", "segment_regressions": ""}
    worse = experiments.compare_scores(joined)["verdict"].first()
    assert worse.verdict == "KEEP" and set(worse.segment_regressions.split(",")) == {"h", "l", "n", "r"}
    overall = by(experiments.compare_scores(joined)["overall"], "model")
    assert overall["first"]["roc_auc"] == 1.0 and overall["first"]["row_count"] == 100
