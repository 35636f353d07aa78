from __future__ import annotations

import pytest
from data import by

from clientpulse import BUY, CART, EVENT_SPECS, SEARCH, VISIT
from clientpulse.operators import prepare, profile

RAW = [
    (1, "2024-01-01 10:00:00", 5),
    (1, "2024-01-01 10:00:00", 5),
    (1, "2024-01-01 10:00:00", 6),
    (2, "not a time", 5),
    (2, None, 5),
    (None, "2024-01-02 00:00:00", 5),
    (3, "2024-01-03 00:00:00", None),
    (3, "2024-01-03 23:59:59.5", 7),
]


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(RAW, "client_id long, timestamp string, sku long")


def test_bad_text_is_counted_and_dropped(raw):
    done = prepare.prepare_events(raw, EVENT_SPECS[CART])
    row = done.report.first()
    assert (row.input_rows, row.valid_rows, row.invalid_rows) == (8, 4, 4)
    assert (row.event_ts_null_count, row.event_ts_parse_failure_count) == (2, 1)
    assert (row.client_id_null_count, row.sku_null_count) == (1, 1)
    assert str(row.event_date_min) == "2024-01-01" and str(row.event_date_max) == "2024-01-03"
    assert done.clean.count() == 4
    assert done.clean.columns == ["client_id", "event_ts", "event_date", "event_type", "sku"]
    assert dict(done.clean.dtypes)["event_type"] == "string"


def test_duplicates(raw):
    row = prepare.prepare_events(raw, EVENT_SPECS[CART]).duplicates.first()
    assert (row.valid_rows, row.duplicate_key_groups, row.duplicate_extra_rows) == (4, 1, 1)
    assert row.duplicate_extra_row_rate == 0.25


def test_empty_input(spark, raw):
    done = prepare.prepare_events(raw.where("false"), EVENT_SPECS[CART])
    assert done.report.first().input_rows == 0
    row = done.duplicates.first()
    assert (row.valid_rows, row.duplicate_extra_rows, row.duplicate_extra_row_rate) == (0, 0, None)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="sku"):
        prepare.validation_counts(spark.createDataFrame([(1, "x")], "client_id long, timestamp string"), EVENT_SPECS[CART])


def test_optional_types_need_to_be_included(spark, raw):
    search = spark.createDataFrame([(1, "2024-01-01 00:00:00", "secret words")], "client_id long, timestamp string, query string")
    visit = spark.createDataFrame([(1, "2024-01-01 00:00:00", 9)], "client_id long, timestamp string, url long")
    tables = {CART: raw, SEARCH: search, VISIT: visit}
    assert {r.event_type for r in prepare.prepare_all(tables).collect()} == {CART}
    everything = prepare.prepare_all(tables, include=(SEARCH, VISIT))
    assert {r.event_type for r in everything.collect()} == {CART, SEARCH, VISIT}
    assert everything.columns == ["client_id", "event_ts", "event_date", "event_type", "sku", "url"]
    with pytest.raises(ValueError):
        prepare.prepare_all(tables, include=("unknown",))
    with pytest.raises(ValueError):
        prepare.prepare_all({SEARCH: search})


def test_sample_bounds(raw):
    with pytest.raises(ValueError):
        prepare.prepare_events(raw, EVENT_SPECS[CART], sample=1.5)
    assert prepare.prepare_events(raw, EVENT_SPECS[CART], sample=1.0).clean.count() == 4


PRODUCTS = [
    (1, 5, 10, "a"),
    (1, 5, 10, "b"),
    (1, 4, 10, "c"),
    (2, 7, 30, "d"),  # tied counts: the smaller category wins
    (2, 6, 40, "e"),
    (3, None, 1, "f"),  # tied counts: a null category loses
    (3, 9, 99, "g"),
    (4, 2, None, "h"),  # tied counts: a null price loses
    (4, 2, 8, "i"),
    (None, 1, 1, None),
]


def test_product_choice(spark):
    df = spark.createDataFrame(PRODUCTS, "sku long, category long, price long, name string")
    clean, report = prepare.prepare_products(df)
    assert {r.sku: (r.category, r.price) for r in clean.collect()} == {1: (5, 10), 2: (6, 40), 3: (9, 99), 4: (2, 8)}
    row = report.first()
    assert (row.input_rows, row.distinct_sku_count, row.null_sku_count, row.output_rows) == (10, 4, 1, 4)
    assert (row.null_category_count, row.null_price_count, row.null_name_count) == (1, 1, 1)
    assert (row.duplicated_sku_count, row.duplicate_extra_rows) == (4, 5)


def test_metadata_verdicts(spark):
    df = spark.createDataFrame(PRODUCTS, "sku long, category long, price long, name string")
    found = {r.metric: r.value for r in prepare.metadata_consistency(df, prepare.dedup_products(df)).collect()}
    assert found["metadata_join_row_expansion_risk"] == "yes"
    assert found["recommended_handling"] == "use_processed_product_properties_clean"
    assert found["raw_max_rows_per_sku"] == "3" and found["processed_max_rows_per_sku"] == "1"
    assert found["raw_sku_with_multiple_category_price_pairs"] == "4"
    same = {r.metric: r.value for r in prepare.metadata_consistency(df, df).collect()}
    assert same["recommended_handling"] == "review_or_deduplicate_before_join"


def test_profile_counts_parse_failures(raw):
    row = profile.profile(raw, CART, exact=True).first()
    assert (row.row_count, row.timestamp_parse_success_count, row.timestamp_parse_failure_count) == (8, 6, 1)
    assert (row.client_id_distinct_count, row.sku_distinct_count, row.timestamp_null_count) == (3, 3, 1)


def test_deferred_counts(raw):
    big = by(profile.table_overview({"t": raw}, {"t": 10}, full=False, limit=5), "table_name")["t"]
    assert (big["row_count"], big["row_count_status"]) == (None, "deferred")
    small = by(profile.table_overview({"t": raw}, {"t": 10}, full=False, limit=50), "table_name")["t"]
    assert (small["row_count"], small["row_count_status"], small["has_sku"], small["has_url"]) == (8, "counted", True, False)


def test_purchase_frequency_of_nothing(spark):
    from data import events

    row = profile.purchase_frequency(events(spark, []).where(f"event_type = '{BUY}'")).first()
    assert row.total_purchasing_clients == 0 and row.purchase_count_median is None
    assert row.average_purchases_per_purchasing_client is None


def test_ids_that_are_no_numbers(spark):
    rows = [("1", "2022-01-01 10:00:00", "5"), ("abc", "2022-01-01 10:00:00", "5"), ("1", "2022-01-02 10:00:00", "x1"),
            (None, "2022-01-02 10:00:00", "abc"), ("2", "never", "6")]
    events = spark.createDataFrame(rows, "client_id string, timestamp string, sku string")
    clean, report, _ = prepare.prepare_events(events, EVENT_SPECS[CART])
    assert [(r.client_id, r.sku) for r in clean.collect()] == [(1, 5)]
    row = report.first()
    assert (row.input_rows, row.valid_rows, row.invalid_rows, row.event_ts_parse_failure_count) == (5, 1, 4, 1)
    assert (row.client_id_null_count, row.client_id_parse_failure_count) == (1, 1)
    assert (row.sku_null_count, row.sku_parse_failure_count) == (0, 2)
    products = spark.createDataFrame(
        [("1", "2", 3, "a"), ("1", "2", 3, "b"), ("abc", "2", 3, "c"), (None, None, 4, None)],
        "sku string, category string, price long, name string",
    )
    best, report = prepare.prepare_products(products)
    row = report.first()
    assert (row.input_rows, row.null_sku_count, row.sku_parse_failure_count, row.distinct_sku_count) == (4, 1, 1, 1)
    assert (row.duplicated_sku_count, row.duplicate_extra_rows, row.output_rows) == (1, 1, best.count())
