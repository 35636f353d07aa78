"""Results that come from one pass, from stored days or from sketches, against the plain ones."""

from __future__ import annotations

import numpy as np
import pytest
from data import SF, SNAP, by, events, products
from pyspark.sql import functions as F

from clientpulse import BUY, CART, SEARCH
from clientpulse.config import EVENT_SPECS
from clientpulse.operators import audit, cohorts, experiments, features, model, prepare, profile, sketches
from clientpulse.plans import jobs
from clientpulse.session import side_session, stable
from clientpulse.sources import fixtures as fx
from clientpulse.sources import read_table


@pytest.fixture(scope="module")
def raw_paths(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    rows = {
        CART: [("1", "2024-01-01 10:00:00", "5"), ("1", "2024-01-01 10:00:00", "5"), ("x", "2024-01-02", "5"), (None, "bad", None), ("2", None, "7")],
        BUY: [("1", "2024-01-03 00:00:00", "5")],
        SEARCH: [("3", "2024-01-04 00:00:00", None)],
    }
    for t, found in rows.items():
        names = ["client_id string", "timestamp string", f"{EVENT_SPECS[t].entity or 'query'} string"]
        spark.createDataFrame(found, ", ".join(names)).write.parquet(f"{base}/{t}")
    goods = [("5", "1", "10", "a"), ("7", "1", "10", "b")]
    spark.createDataFrame(goods, "sku string, category string, price string, name string").selectExpr(
        "bigint(sku) sku", "bigint(category) category", "bigint(price) price", "name"
    ).write.parquet(f"{base}/products")
    return str(base), list(rows)


def test_counters_come_from_the_write(spark, raw_paths):
    base, types = raw_paths
    side = side_session(spark)
    frames = {t: read_table(side, f"{base}/{t}") for t in types}
    clean, seen = prepare.prepare_observed(frames, (SEARCH,))
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f"{base}/{t}") for t in types] == [1, 1, 1] and plan.count("FileScan parquet") == 3
    stored = stable(clean)
    assert stored.count() == 4
    found = by(prepare.observed_report(spark, seen), "event_type")
    for t in types:
        want = prepare.validation_counts(frames[t], EVENT_SPECS[t]).first().asDict()
        assert {k: found[t][k] for k in want} == want
    assert found[CART]["invalid_rows"] == 3 and found[CART]["client_id_parse_failure_count"] == 1


def test_models_fit_beside_observations(spark, raw_paths, tmp_path):
    base, types = raw_paths
    jobs.prepare(spark, {t: f"{base}/{t}" for t in types}, f"{base}/products", str(tmp_path / "run"))
    rows = [(i, float(i % 7), int(i % 7 > 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "client_id long, a double, label int")
    assert model.score(model.fit(df, ["a"]), df).count() == 60


def test_prepare_writes_the_same_reports(spark, raw_paths, tmp_path):
    base, types = raw_paths
    out = str(tmp_path / "run")
    jobs.prepare(spark, {t: f"{base}/{t}" for t in types}, f"{base}/products", out, include=())
    report = by(spark.read.option("header", True).csv(f"{out}/reports/validation"), "event_type")
    assert set(report) == set(types) and report[CART]["valid_rows"] == "2" and report[SEARCH]["input_rows"] == "1"
    twice = by(spark.read.option("header", True).csv(f"{out}/reports/duplicates"), "event_type")
    assert twice[CART]["duplicate_key_groups"] == "1" and twice[BUY]["duplicate_extra_rows"] == "0"


def test_features_from_days_equal_features_from_events(spark):
    days = features.daily_activity(events(spark))
    assert days.count() < events(spark).count()
    for source in (days, stable(days)):
        found = by(features.build_features(source, products(spark), SNAP, active_windows=(30,)), "client_id")
        assert found == by(features.build_features(events(spark), products(spark), SNAP, active_windows=(30,)), "client_id")
    assert by(features.activity_features(days, SNAP.cutoff), "client_id") == by(features.activity_features(events(spark), SNAP.cutoff), "client_id")


def test_days_of_any_range_merge(spark):
    ev = fx.stream_events(spark, SF)
    days = stable(sketches.daily_sketches(ev))
    half = F.col("event_date") < "2024-01-16"
    got = by(sketches.overview_of_days(days.where(half)), "event_type")
    want = by(profile.event_overview(ev.where(half)), "event_type")
    for t, row in want.items():
        assert got[t]["row_count"] == row["row_count"]
        for c in ("distinct_client_id_count", "distinct_entity_count"):
            assert abs(got[t][c] - row[c]) <= max(1, sketches.HLL_ERROR * row[c])


def test_value_sketches_keep_their_bounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 7), float(v), None if i % 3 else float(i % 11), float("nan"), None) for i, v in enumerate(rng.lognormal(size=30_000))]
    df = spark.createDataFrame(rows, "day int, skewed double, few double, missing double, none double").repartition(6)
    names, q = ["skewed", "few", "missing", "none"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = by(sketches.stats_of_values(sketches.value_sketches(df, names, "day"), q), "feature_name")
    values = np.sort([r[1] for r in rows])
    for n, share in q.items():
        rank = np.searchsorted(values, got["skewed"][n]) / len(values)
        assert abs(rank - share) <= sketches.KLL_ERROR
    assert got["skewed"]["mean"] == pytest.approx(values.mean()) and got["skewed"]["variance"] == pytest.approx(values.var(ddof=1))
    assert abs(got["skewed"]["distinct_count"] / len(values) - 1) <= sketches.HLL_ERROR
    assert (got["few"]["distinct_count"], got["few"]["max"]) == (11, 10.0)
    assert all(got[c]["non_null_count"] == 0 and got[c]["p50"] is None and got[c]["row_count"] == 30_000 for c in ("missing", "none"))


def test_cohorts_beyond_the_exact_size_of_a_sketch(spark):
    n = 60_000
    ids = spark.range(n).withColumnRenamed("id", "client_id")
    at = F.to_timestamp(F.lit("2024-02-01"))
    made = [(CART, "client_id % 2 = 0"), (BUY, "client_id % 3 = 0"), (SEARCH, "client_id % 5 = 0")]
    ev = None
    for kind, test in made:
        part = ids.where(test).select("client_id", at.alias("event_ts"), F.to_date(at).alias("event_date"), F.lit(kind).alias("event_type"))
        ev = part if ev is None else ev.unionByName(part)
    got = by(sketches.sketched_overlaps(sketches.cohort_sketches(ev, SNAP)), "left_candidate", "right_candidate")
    want = by(cohorts.overlap_matrix(cohorts.cohort_flags(ev, SNAP)), "left_candidate", "right_candidate")
    assert got.keys() == want.keys()
    for k, row in want.items():
        union = row["left_count"] + row["right_count"] - row["intersection_count"]
        assert abs(got[k]["intersection_count"] - row["intersection_count"]) <= sketches.THETA_ERROR * union
        assert abs(got[k]["jaccard_rate"] - row["jaccard_rate"]) <= sketches.THETA_ERROR


def test_pairwise_correlations_multiply_no_rows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b = rng.normal(), rng.normal()
        rows.append((1e6 + a, a + b if i % 3 else None, b if i % 4 else None, 5.0 if i % 5 else None, None))
    df = spark.createDataFrame(rows, "a double, b double, c double, constant double, none double").repartition(3)
    columns = df.columns
    got = audit.correlations(df, columns, nulls="skip")
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        i, j = columns.index(x), columns.index(y)
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        assert got[x, y] == got[y, x] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
    assert not any("constant" in k or "none" in k for k in got)
    plan = audit.known_entries(df, columns)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    assert audit.correlations(df.where("false"), columns, nulls="skip") == {}


@pytest.mark.parametrize("rule", ["not_worse", "gain", "review", "any_gain", "both_gain"])
def test_decisions_as_columns(spark, rule):
    base = {"pr_auc": 0.2, "lift_at_5pct": 2.0}
    rows = [(0.2 * p, 2.0 * q) for p in (0.9, 0.992, 0.997, 1.0, 1.004, 1.02) for q in (0.9, 0.992, 0.997, 1.0, 1.004, 1.02)] + [(None, 2.0)]
    df = spark.createDataFrame(rows, "pr_auc double, lift_at_5pct double")
    given = {m: F.lit(v) for m, v in base.items()}
    metrics = {m: F.col(m) for m in base}
    for r in df.withColumn("got", experiments.decision(metrics, given, rule)).where("pr_auc is not null").collect():
        assert r.got == experiments.decide(r.asDict(), base, rule)
    with pytest.raises(ValueError):
        experiments.decision(metrics, given, "other")
