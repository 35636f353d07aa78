from __future__ import annotations

import pytest
from data import SF, SNAP, by, events

from pyspark.sql import functions as F

from clientpulse import BUY, CART, SEARCH
from clientpulse.operators import features, paths
from clientpulse.sources import fixtures as fx

CUT = "2024-03-01"


def transitions(spark, rows, **kw):
    return by(features.transition_features(events(spark, rows), CUT, **kw), "client_id")


def test_search_window_includes_both_ends(spark):
    rows = [
        (1, "2024-02-10 00:00:00", SEARCH, None),
        (1, "2024-02-10 00:00:00", CART, 1),  # same instant
        (1, "2024-02-17 00:00:00", CART, 2),  # exactly 7 days later
        (1, "2024-02-17 00:00:01", CART, 3),  # one second too late
        (1, "2024-02-09 23:59:59", CART, 4),  # before the search
        (2, "2024-02-10 00:00:00", CART, 4),  # no search at all
    ]
    found = transitions(spark, rows)
    assert found[1]["search_before_cart_count"] == 2
    assert found[1]["search_to_cart_rate"] == pytest.approx(3 / 6)
    assert (found[2]["search_before_cart_count"], found[2]["search_to_cart_rate"]) == (0, pytest.approx(1 / 3))


def test_duplicate_carts_count_and_duplicate_searches_do_not(spark):
    rows = [(1, "2024-02-10 00:00:00", SEARCH, None)] * 3 + [(1, "2024-02-11 00:00:00", CART, 1)] * 2
    assert transitions(spark, rows)[1]["search_before_cart_count"] == 2


def test_recent_flag(spark):
    rows = [
        (1, "2024-01-31 00:00:00", SEARCH, None),  # first recent day
        (1, "2024-01-31 00:00:00", CART, 1),
        (2, "2024-01-30 23:59:59", SEARCH, None),  # too old
        (2, "2024-02-20 00:00:00", CART, 1),
        (3, "2024-02-20 00:00:00", SEARCH, None),  # after the cart
        (3, "2024-02-19 00:00:00", CART, 1),
        (4, "2024-03-01 00:00:00", SEARCH, None),  # not history
        (4, "2024-03-02 00:00:00", CART, 1),
        (5, "2024-02-20 00:00:00", SEARCH, None),
        (5, "2024-02-29 23:59:59", CART, 1),
    ]
    flags = {c: r["recent_search_then_cart_flag"] for c, r in transitions(spark, rows).items()}
    assert flags == {1: 1, 2: 0, 3: 0, 5: 1}
    assert set(by(paths.recent_then(events(spark, rows), CUT), "client_id")) == {1, 5}


def test_added_columns_are_filled(spark):
    base = spark.createDataFrame([(1,), (9,)], "client_id long")
    rows = [(1, "2024-02-10 00:00:00", SEARCH, None), (1, "2024-02-11 00:00:00", CART, 1)]
    found = by(features.add_transition_features(base, events(spark, rows), CUT), "client_id")
    assert (found[9]["search_before_cart_count"], found[9]["search_to_cart_rate"]) == (0, 0.0)
    assert found[9]["recent_search_then_cart_flag"] == 0 and found[1]["recent_search_then_cart_flag"] == 1
    flagged = by(features.add_recent_flag(base, events(spark, rows), CUT), "client_id")
    assert {c: r["recent_search_then_cart_flag"] for c, r in flagged.items()} == {1: 1, 9: 0}


@pytest.mark.parametrize("days", [1, 7])
def test_same_as_the_row_level_join(spark, days):
    ev = fx.stream_events(spark, SF, CART, SEARCH)
    cutoff = fx.EVENTS_SNAPSHOT.cutoff
    history = ev.where(F.col("event_date") < F.lit(cutoff).cast("date"))
    carts = history.where(f"event_type = '{CART}'").select("client_id", F.col("event_ts").alias("c"))
    searches = history.where(f"event_type = '{SEARCH}'").select("client_id", F.col("event_ts").alias("s"))
    gap = (F.col("s") <= F.col("c")) & (F.col("s") >= F.col("c") - F.expr(f"INTERVAL {days} DAYS"))
    near = carts.alias("a").join(searches.alias("b"), (F.col("a.client_id") == F.col("b.client_id")) & gap, "left_semi")
    expected = {r.client_id: r["count"] for r in near.groupBy("client_id").count().collect()}
    found = by(features.transition_features(ev, cutoff, days), "client_id")
    assert {c: r["search_before_cart_count"] for c, r in found.items() if r["search_before_cart_count"]} == expected


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**7])
@pytest.mark.parametrize("inclusive", [True, False])
def test_latest_is_found_across_slices(spark, slice_seconds, inclusive):
    marks = [0, 5, 5000, 90000, 90001]
    times = sorted({*marks, 1, 4999, 5001, 89999, 200000})
    rows = [(1, t, t if t in marks else None) for t in times] + [(2, 7, None)]
    df = spark.createDataFrame(rows, "k long, t long, m long").select(
        "k", F.timestamp_seconds("t").alias("t"), F.timestamp_seconds("m").alias("m")
    )
    found = paths.latest_marked(df, ["k"], "t", "m", inclusive, slice_seconds)
    got = {(r.k, r.t): r.latest for r in found.select("k", F.unix_seconds("t").alias("t"), F.unix_seconds("latest").alias("latest")).collect()}
    for t in times:
        earlier = [m for m in marks if (m <= t if inclusive else m < t)]
        assert got[1, t] == (max(earlier) if earlier else None)
    assert got[2, 7] is None


def test_asof_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (1, 20), (None, 10)], "k long, t long").select("k", F.timestamp_seconds("t").alias("l"))
    right = spark.createDataFrame([(1, 10), (1, 15), (2, 5)], "k long, t long").select("k", F.timestamp_seconds("t").alias("r"))

    def run(inclusive):
        rows = paths.asof_latest(left, right, ["k"], "l", "r", inclusive)
        return sorted((r.k or 0, r.l, r.x or 0) for r in rows.select("k", F.unix_seconds("l").alias("l"), F.unix_seconds("latest_r").alias("x")).collect())

    assert run(True) == [(0, 10, 0), (1, 10, 10), (1, 10, 10), (1, 20, 15)]
    assert run(False) == [(0, 10, 0), (1, 10, 0), (1, 10, 0), (1, 20, 15)]


def test_purchase_path(spark):
    found = by(paths.purchase_path(events(spark), SNAP), "metric")
    values = {m: r["value"] for m, r in found.items()}
    assert values == {
        "target_window_buyers": 3,
        "target_window_buyers_with_add_to_cart_before_cutoff": 1,
        "target_window_buyers_without_add_to_cart_before_cutoff": 2,
        "target_window_buyers_with_prior_same_sku_cart_before_first_purchase": 1,
        "target_purchase_events": 4,
        "target_purchase_events_with_prior_same_sku_add_to_cart": 2,
    }
    row = paths.cart_delay_quantiles(events(spark), SNAP).first()
    # sku 10: cart 02-29, purchase 03-01; sku 12: cart 01-31, purchase 03-10
    assert (row.path_count, row.min_delay_days, row.max_delay_days, row.p50_delay_days) == (2, 1, 39, 20.0)


def test_path_of_nothing(spark):
    rows = by(paths.purchase_path(events(spark, []), SNAP), "metric")
    assert {r["value"] for r in rows.values()} == {0} and {r["rate"] for r in rows.values()} == {None}
    assert paths.cart_delay_quantiles(events(spark, []), SNAP).first().path_count == 0


def test_buy_type_only(spark):
    only = events(spark).where(F.col("event_type") == BUY)
    assert by(paths.purchase_path(only, SNAP), "metric")["target_window_buyers"]["value"] == 3
