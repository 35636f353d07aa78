from __future__ import annotations

import pytest
from data import EVENTS, SNAP, by, events, products

from clientpulse import BUY, CART, FEATURE_SETS, SEARCH
from clientpulse.config import feature_families, feature_names
from clientpulse.operators import audit, features, labels


@pytest.fixture(scope="module")
def table(spark):
    return by(features.build_features(events(spark), products(spark), SNAP), "client_id")


def test_columns(spark):
    df = features.build_features(events(spark), products(spark), SNAP)
    assert df.columns == ["client_id", *feature_names()] and len(feature_names()) == 36
    assert features.feature_catalog(df).count() == 36
    audit.check_families(feature_names(), feature_families())


def test_history_ends_before_the_cutoff(table):
    one = table[1]
    assert (one["add_to_cart_count"], one["distinct_add_to_cart_sku_count"]) == (5, 3)
    assert one["days_since_last_add_to_cart"] == 1
    assert (one["product_buy_count"], one["days_since_last_product_buy"]) == (1, 5)
    assert 5 not in table


def test_window_edges(table):
    # the 30 day window starts on 2024-01-31: that day is in, the day before is out
    one = table[1]
    assert [one[f"add_to_cart_count_{w}d"] for w in (30, 60, 90)] == [4, 5, 5]


def test_exact_duplicates_count_as_behaviour(table):
    assert table[1]["add_to_cart_count_30d"] == 4


def test_null_policy(table):
    two, three, four = table[2], table[3], table[4]
    assert two["add_to_cart_count"] == 0 and two["days_since_last_add_to_cart"] is None
    assert two["buy_to_cart_ratio"] is None and two["avg_cart_price"] is None
    assert (two["search_query_count"], two["distinct_search_days"], two["active_days_count"]) == (3, 2, 2)
    assert (two["is_eligible_purchase_propensity"], three["is_eligible_purchase_propensity"]) == (0, 0)
    assert four["is_eligible_purchase_propensity"] == 1 and four["search_to_cart_ratio"] is None
    assert three["cart_minus_remove_count"] == -1


def test_products(table):
    one = table[1]
    # skus 10, 10, 10, 12, 13: the unpriced one and the uncategorised one do not count
    assert one["distinct_cart_category_count"] == 2
    assert one["avg_cart_price"] == (3 * 100 + 500) / 4
    assert one["max_cart_price"] == 500
    assert (one["distinct_bought_category_count"], one["avg_bought_price"]) == (1, 100)


def test_active_days(spark, table):
    assert table[1]["active_days_count"] == 6
    assert by(features.active_days(events(spark), SNAP.cutoff), "client_id")[1]["active_days_count"] == 6
    assert by(features.active_days(events(spark), SNAP.cutoff, 30), "client_id")[1]["active_days_count_30d"] == 5


def test_later_events_change_nothing(spark, table):
    later = EVENTS + [
        (c, ts, t, 12) for c in (1, 2, 9) for ts in ("2024-03-01 00:00:00", "2024-04-01 00:00:00") for t in (CART, BUY, SEARCH)
    ]
    again = by(features.build_features(events(spark, later), products(spark), SNAP), "client_id")
    assert again == table


def test_pieces_agree_with_the_table(spark, table):
    activity = by(features.activity_features(events(spark), SNAP.cutoff), "client_id")
    goods = by(features.product_features(events(spark), products(spark), SNAP.cutoff), "client_id")
    for client, row in table.items():
        assert {k: v for k, v in activity[client].items()} == {k: row[k] for k in activity[client]}
        if client in goods:
            assert goods[client] == {k: row[k] for k in goods[client]}


def test_labels(spark):
    table = features.build_features(events(spark), products(spark), SNAP)
    joined = by(labels.build_labels(table, events(spark), SNAP), "client_id")
    # both edges of the window are in, the day after is out; client 5 has no history
    assert {c: (r["label"], r["target_event_count"]) for c, r in joined.items()} == {1: (1, 2), 4: (1, 1)}
    assert by(labels.labels_from_events(events(spark), SNAP), "client_id") == joined
    assert joined[1]["target_window_start"] == "2024-03-01" and joined[1]["target_window_end"] == "2024-03-10"


def test_label_checks(spark):
    table = features.build_features(events(spark), products(spark), SNAP)
    found = labels.labels_from_events(events(spark), SNAP)
    training = labels.training_set(table, found)
    checks = by(labels.label_checks(table, found, training, expected_eligible=2, expected_positive=2), "check_name")
    assert len(checks) == 11 and {r["status"] for r in checks.values()} == {"pass"}
    wrong = by(labels.label_checks(table, found.union(found), training, expected_positive=9), "check_name")
    failed = {name for name, r in wrong.items() if r["status"] == "fail"}
    assert failed == {
        "label_row_count_equals_eligible_cohort_count",
        "positive_count_matches_expected",
        "no_duplicate_client_id_in_label_table",
        "training_row_count_equals_label_row_count",
    }


def test_label_like_features_are_refused(spark):
    table = features.build_features(events(spark), products(spark), SNAP).withColumn("target_x", features.F.lit(1))
    with pytest.raises(ValueError, match="target_x"):
        labels.build_labels(table, events(spark), SNAP)


def test_feature_set_sizes():
    sizes = {name: len(fs.columns(feature_names())) for name, fs in FEATURE_SETS.items()}
    assert sizes == {"baseline": 36, "v2_1": 31, "v2_2": 27, "v2_3a": 25, "v2_3b": 30, "v2_3c": 28, "e6": 33, "v2_4": 32}


def test_search_buckets(spark):
    rows = [(i, n, d) for i, (n, d) in enumerate([(0, None), (1, 5), (2, 7), (5, 8), (6, 30), (20, 31), (21, 61), (None, None)])]
    df = spark.createDataFrame(rows, "client_id int, search_query_count long, days_since_last_search_query int")
    found = by(features.search_buckets(df, (7, 30, 60)), "client_id")
    assert [found[i]["search_count_bucket"] for i in range(8)] == [0, 1, 2, 2, 3, 3, 4, 0]
    assert [found[i]["search_recency_bucket"] for i in range(8)] == [0, 1, 1, 2, 2, 3, 4, 0]
    assert [found[i]["recent_search_flag"] for i in range(8)] == [0, 1, 1, 1, 1, 0, 0, 0]


def test_recency_thresholds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "days_since_last_search_query double")
    assert features.recency_thresholds(df) == (25, 50, 75)
    assert features.recency_thresholds(df.where("false")) == (7, 30, 60)
    assert features.recency_thresholds(df.where("days_since_last_search_query = 3")) == (7, 30, 60)


def test_velocity(spark):
    names = [f"{t}_count_{w}d" for t in (CART, BUY, SEARCH) for w in (30, 90)]
    schema = "client_id long, active_days_count long, active_days_count_30d long, " + ", ".join(f"{n} long" for n in names)
    df = spark.createDataFrame([(1, 3, 1, 2, 6, None, None, 0, 4)], schema)
    row = features.velocity_features(df).first()
    assert row.cart_velocity_30d_vs_90d == pytest.approx(3 / 7) and row.cart_delta_30d_90d == 0
    assert (row.buy_velocity_30d_vs_90d, row.buy_delta_30d_90d) == (1.0, 0.0)
    assert row.search_velocity_30d_vs_90d == 0.2 and row.activity_intensity_ratio == 0.5
    assert "active_days_count_30d" not in row.asDict()


def test_one_client_with_most_events(spark):
    hot = [(1, f"2024-02-{1 + i % 28:02d} 0{i % 10}:00:00", t, i % 37) for i in range(3000) for t in (CART, BUY)]
    table = by(features.build_features(events(spark, EVENTS + hot), products(spark), SNAP), "client_id")
    assert table[1]["add_to_cart_count"] == 3005 and table[1]["distinct_add_to_cart_sku_count"] == 37
    assert table[4]["product_buy_count"] == 1
